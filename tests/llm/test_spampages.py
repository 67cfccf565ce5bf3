import random

import pytest

from tradespan.llm.spampages import PageRule, cue_shapes, cue_texts, kind_of, page_shapes, shape_figures, spam_pages, spam_share


def page(*cues):
    return "\n\n".join(f"{i}\n00:00:{i:02d},000 --> 00:00:{i:02d},900\n{c}" for i, c in enumerate(cues, 1))


TALK = ["Where were you?", "I saw it on www.noknok.example yesterday, remember?", "Nothing. Just a letter\nin the dark.", "- No, no.\n- Yes!", "[door creaks]"]
SPAM = {
    "keywords": "sale diet pills deal diet pills cheap diet pills",
    "links": "http://some.example/diet-pills/12",
    "tags": "#diet #dietpills #sale #diet",
    "offers": "Diet Pills A30 | XL | SKU 38769 | $53.99",
}


@pytest.mark.parametrize("cue,kind", [(v, k) for k, v in SPAM.items()] + [("pills (dot) example / lamp-oil", "links"), ('<a href="http://a.test/1">lamp oil</a>', "links"), ("> lampe bleue: abc.example/1", "links"), ("♪ La la la, la la la ♪", "song"), ("� Oh Ann, oh Bob, don�t go �", "song"), ("ONLY 6 OF THE PLANS SURVIVED", "sentence"), ("(laughs)", "sound"), ("Is it, now, or later", "sentence")])
def test_kind_of_a_cue(cue, kind):
    assert cue_shapes(page(cue))[0][0] == kind


def test_terms_need_words_of_other_cues():
    lists = ["lamp oil top, best cat tree, loan offer price", "cat tree deal, loan offer top, best lamp oil", "price cat tree, lamp oil deal, loan offer"]
    assert {k for k, _ in cue_shapes(page(*lists))} <= {"terms", "keywords"}
    assert cue_shapes(page(lists[0], *TALK))[0][0] == "sentence"


def test_majority_decides(spark):
    spam = list(SPAM.values())
    rows = [(1, page(*spam, *TALK[:3])), (2, page(*spam, *TALK[:4])), (3, page(*TALK)), (4, None), (5, ""), (6, "no cues, just text"), (7, page(*["♪ La la la ♪"] * 9)), (1, page(*spam, *TALK[:3])), (8, page(*(spam * 3000)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS cues", "2 AS spam_share")
    assert sorted(r.doc_id for r in spam_pages(df).collect()) == [1, 1, 8]
    got = {r.doc_id: (r.cues, r.spam_share) for r in page_shapes(df).collect()}
    assert got[2] == (8, 0.5) and got[4] == got[5] == got[6] == (0, 0.0)
    assert spam_pages(df.limit(0)).count() == 0


def test_cues_of_all_styles():
    text = "WEBVTT\r\n\r\n1\r\n00:00:01.000 --> 00:00:02.000\r\na\r\nb\r\n\r\n#7\r00:00:03,000 -> 00:00:04,000\rc"
    assert [c.split() for c in cue_texts(text)] == [["a", "b"], ["c"]]


def test_all_non_sentences_count_however_many_their_shapes(spark):
    kinds = [("links", f"links:{i}") for i in range(100)] + [("sentence", "sentence:")] * 99
    assert spam_share(kinds) == 100 / 199 and spam_share(kinds, 64) == 64 / 199
    spam = list(SPAM.values())
    df = spark.createDataFrame([(1, page(*spam, *TALK[:3]))], "doc_id bigint, text string")
    one = PageRule(few=1)
    assert spam_pages(df, one).count() == 1
    r = page_shapes(df, one).first()
    assert r.few_share < 0.5 < r.spam_share


VOCABULARY = {
    "en": "cheap watch online free deal best price sale order shop".split(),
    "ru": "дешёвые часы онлайн бесплатно скидка лучшие цена купить заказ магазин".split(),
    "el": "φθηνά ρολόγια δωρεάν προσφορά καλύτερη τιμή αγορά παραγγελία κατάστημα έκπτωση".split(),
    "hi": "सस्ती घड़ी ऑनलाइन मुफ़्त सौदा सबसे कीमत बिक्री दुकान छूट".split(),
    "ar": "ساعات رخيصة مجانا عرض أفضل سعر بيع شراء متجر خصم".split(),
    "zh": "便宜 手表 免费 优惠 最好 价格 购买 订单 商店 折扣".split(),
}
SPEECH = {
    "en": ["Where were you last night?", "I told them, again and again, that it was late.", "Nobody knows what happened.", "We should leave before dawn.", "No, no, no. Not like this!", "Come here and look at this.", "They never came back to the house.", "Is that what you wanted to say?"],
    "ru": ["Где ты был прошлой ночью?", "Я говорил им, снова и снова, что уже поздно.", "Никто не знает, что случилось.", "Нам надо уйти до рассвета.", "Нет, нет, нет. Только не так!", "Иди сюда и посмотри на это.", "Они так и не вернулись домой.", "Ты это хотел сказать?"],
    "el": ["Πού ήσουν χθες το βράδυ;", "Τους το είπα, ξανά και ξανά, ότι ήταν αργά.", "Κανείς δεν ξέρει τι έγινε.", "Πρέπει να φύγουμε πριν ξημερώσει.", "Όχι, όχι, όχι. Όχι έτσι!", "Έλα εδώ και κοίτα αυτό.", "Δεν γύρισαν ποτέ στο σπίτι.", "Αυτό ήθελες να πεις;"],
    "hi": ["तुम कल रात कहाँ थे?", "मैंने उनसे कहा, बार बार, कि देर हो गई है।", "कोई नहीं जानता क्या हुआ।", "हमें सुबह से पहले निकलना चाहिए।", "नहीं, नहीं, नहीं। ऐसे नहीं!", "यहाँ आओ और इसे देखो।", "वे कभी घर वापस नहीं आए।", "क्या तुम यही कहना चाहते थे?"],
    "ar": ["أين كنت الليلة الماضية؟", "قلت لهم، مرة بعد مرة، إن الوقت متأخر.", "لا أحد يعرف ماذا حدث.", "يجب أن نرحل قبل الفجر.", "لا، لا، لا. ليس هكذا!", "تعال هنا وانظر إلى هذا.", "لم يعودوا إلى البيت أبدا.", "هل هذا ما أردت قوله؟"],
    "zh": ["你昨晚在哪里？", "我一再告诉他们，已经很晚了。", "没有人知道发生了什么。", "我们应该在天亮前离开。", "不，不，不。不要这样！", "过来看看这个。", "他们再也没有回家。", "这就是你想说的吗？"],
}


def labelled(seed=11, pages=40):
    """(text, is spam) in every script; keyword runs and lists with and without full stops, links, tags and offers."""
    rng = random.Random(seed)
    out = []
    for lang, words in VOCABULARY.items():
        stop = {"zh": "。", "hi": "।"}.get(lang, ".")
        for n in range(pages):
            style, end = ("run", "list", "tags", "links", "offers")[n % 5], stop if n % 2 else ""
            item = rng.sample(words, 2)

            def cue(style=style, item=item, end=end):
                if style == "run":
                    return " ".join(w for _ in range(3) for w in (rng.choice(words), *item)) + end
                if style == "list":
                    return ", ".join(" ".join(rng.sample(words, 2)) for _ in range(rng.randint(3, 5))) + end
                if style == "tags":
                    return " ".join("#" + "".join(rng.sample(words, 2)) for _ in range(rng.randint(3, 6)))
                if style == "links":
                    return f"{rng.choice(words)} https://shop{rng.randint(1, 99)}.example/{rng.randint(1, 999)}"
                return f"{' '.join(item)} {rng.choice('ABC')}{rng.randint(1, 99)} | SKU {rng.randint(100, 999)} | ${rng.randint(1, 99)}.99"

            spam = [cue() for _ in range(rng.randint(8, 20))]
            out.append((page(*spam, *rng.sample(SPEECH[lang], len(spam) // 4)), True))
            talk = [rng.choice(SPEECH[lang]) for _ in range(rng.randint(12, 30))]
            out.append((page(*talk, *(cue() for _ in range(len(talk) // 3))), False))
    return out


def test_recall_and_precision_in_several_scripts():
    judged = [(spam, spam_share(cue_shapes(text)) > PageRule().share) for text, spam in labelled()]
    hit = sum(a and b for a, b in judged)
    assert hit >= 0.95 * sum(a for a, _ in judged) and hit >= 0.95 * sum(b for _, b in judged)


def test_wrongly_decoded_keywords_of_another_script():
    run = "часы онлайн скидка часы онлайн цена часы онлайн".encode().decode("latin-1")
    assert cue_shapes(page(run))[0][0] == "keywords"


def test_a_shape_alone_gives_the_kind_and_figures_count_all_cues(spark):
    texts = [page(*SPAM.values(), *TALK[:3]), page(*TALK), None]
    shapes = [x for t in texts if t for x in cue_shapes(t)]
    assert all(kind_of(shape) == kind for kind, shape in shapes)
    rows = shape_figures(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")).collect()
    assert sum(r.cues for r in rows) == len(shapes) and sum(r.flagged_cues for r in rows) == 7
    assert {(r.kind, r["shape"]) for r in rows} == set(shapes)
