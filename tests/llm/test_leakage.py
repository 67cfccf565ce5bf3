import random

import pytest
import regex

from tradespan.llm.leakage import leaked_pairs, leaked_passages, removal_spans, suite_instructions
from tradespan.llm.words import word_keys, word_places

WORDS = [a + b for a in ("ba", "ko", "mel", "tru", "zin", "ora") for b in ("dan", "vek", "sil", "mor", "put", "gal", "hun")]
DOC = "doc_id bigint, text string"
ITEM = "item_id bigint, suite string, text string"


def speech(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def cues(words, rng, arrow="-->", end="\n"):
    out, i, k = [], 0, 1
    while i < len(words):
        n = rng.randrange(3, 7)
        out += [str(k), f"00:0{k % 10}:01,500 {arrow} 00:0{k % 10}:03,000", " ".join(words[i : i + n]), ""]
        i, k = i + n, k + 1
    return end.join(out)


def damaged(words, rng):
    out = []
    for w in words:
        kind = rng.randrange(12)
        out.append({0: w.upper(), 1: w + ",", 2: f"<i>{w}</i>", 3: w.replace("o", "0"), 4: w.replace("l", "I"), 5: w.replace("m", "rn"), 6: f"- {w}", 7: f"[door creaks] {w}", 8: w + "â€™", 9: "{\\an8}" + w}.get(kind, w))
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    intro = "Answer the question about this text now please friend. "
    items = {i: speech(rng, 30) for i in range(1, 7)}
    rows = [(i, "s" if i < 4 else "t", (intro if i < 4 else "") + " ".join(w)) for i, w in items.items()]
    docs, want = [], set()
    for d in range(60):
        words = speech(rng, 40)
        n = rng.choice([0, 6, 11, 12, 13, 25])
        i = rng.randrange(1, 7)
        if n:
            a = rng.randrange(0, 30 - n + 1)
            part = items[i][a : a + n]
            at = rng.randrange(5, 35)
            words = words[:at] + ["qqq"] + (damaged(part, rng) if d % 2 else part) + ["qqq"] + words[at:]
            if n >= 12:
                want.add((d, i))
        docs.append((d, cues(words, rng, "->" if d % 5 == 0 else "-->", "\r\n" if d % 7 == 0 else "\n")))
    docs += [(100, cues(intro.split() * 2, rng)), (101, None), (102, ""), (103, docs[7][1]), (104, " ".join(speech(rng, 60_000)))]
    if any(x[0] == 7 for x in want):
        want |= {(103, i) for d, i in want if d == 7}
    docs.append((105, " ".join(speech(rng, 50_000) + items[5] + speech(rng, 50_000))))
    want.add((105, 5))
    return spark.createDataFrame(docs, DOC), spark.createDataFrame(rows, ITEM), want, items


def test_pairs_equal_what_was_planted(corpus):
    docs, items, want, _ = corpus
    assert {tuple(r) for r in leaked_pairs(docs, items).collect()} == want


def test_blocks_and_shards_don_t_matter(corpus):
    docs, items, want, _ = corpus
    got = leaked_passages(docs, items, item_block=2, shard_bytes=2000).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        assert r.words >= 12 and 0 <= r.start < r.end <= len(text[r.doc_id])


def test_spans_cover_the_passage(corpus):
    docs, items, _, words = corpus
    span = removal_spans(docs, items).where("doc_id = 105").first()
    text = docs.where("doc_id = 105").first().text
    assert text[span.start : span.end] == " ".join(words[5])


def test_shared_instruction(corpus):
    _, items, _, _ = corpus
    assert suite_instructions(items) == {"s": "Answer the question about this text now please friend. "}


def test_odd_tables(spark, corpus):
    docs, items, want, _ = corpus
    none = spark.createDataFrame([(None, None, None), (9, None, None), (10, "u", "")], ITEM)
    clash = docs.selectExpr("*", "1 AS item_id", "2 AS words", "'x' AS lang")
    assert {tuple(r) for r in leaked_pairs(clash, items.unionByName(none).selectExpr("*", "3 AS doc_id")).collect()} == want
    assert leaked_pairs(docs.limit(0), items).count() == 0
    assert leaked_pairs(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize(
    "a,b",
    [("él midió la cañón", "йl midiу la caсуn"), ("isso é só", "isso й sу"), ("Café — déjà vu", "CafÃ© â€” dÃ©jÃ\xa0 vu"), ("molino rápido", "rnolino r�pido"), ("the wheel", "tbe vvhccI"), ("Straße süß", "Strasse sü?"), ("Gavin’s hat", "Gavin&#39;s HAT"), ("a [laughs] b", "a b"), ("x 1\n\n2\n00:00:01,000 --> 00:00:02,000\ny", "x 1 y")],
)
def test_one_key_for_all_writings(a, b):
    assert word_keys([a.encode()])[0].tolist() == word_keys([b.encode()])[0].tolist()


def test_places_match_keys():
    text = "1\r\n00:00:01,000 --> 00:00:02,000\r\n<i>Hé, it’s - well-known</i> [noise]\r\nÃ\xa0 la \x01 &amp; carte (x)\r\n"
    keys = word_keys([text.encode()])[0]
    assert len(word_places(text)) == len(keys)
    assert [text[a:b] for a, b in word_places(text)][:3] == ["Hé", "it’s", "well"]


def test_halves_are_joined_beside_other_runs_of_the_item(spark):
    rng = random.Random(8)
    item = rng.sample(WORDS, 20)
    torn = item[:10] + [item[10][:3], item[10][3:]] + item[11:19]
    # the item's words around the torn one, said elsewhere, stand between the halves by place in the item
    other = item[5:15]
    items = spark.createDataFrame([(1, "t", " ".join(item)), (2, "t", " ".join(speech(rng, 20)))], ITEM)
    texts = [torn, torn + ["qqq"] + other, other + ["qqq"] + torn, item[:10] + ["qqq"] + item[11:19], other]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], DOC)
    assert {(r.doc_id, r.item_id) for r in leaked_pairs(docs, items).collect()} == {(0, 1), (1, 1), (2, 1)}


SCRIPTS = {
    "ru": "никто не знает почему старый маяк светил каждую ночь до самого утра пока рыбаки ждали лодки у холодного берега",
    "el": "κανείς δεν ξέρει γιατί ο παλιός φάρος έλαμπε κάθε νύχτα μέχρι το πρωί ενώ οι ψαράδες περίμεναν τις βάρκες",
    "hi": "कोई नहीं जानता कि पुराना प्रकाशस्तंभ हर रात सुबह तक क्यों चमकता था जबकि मछुआरे ठंडे तट पर नावों की प्रतीक्षा करते थे",
    "ar": "لا أحد يعرف لماذا كانت المنارة القديمة تضيء كل ليلة حتى الصباح بينما كان الصيادون ينتظرون القوارب عند الشاطئ البارد",
    "ko": "왜 오래된 등대가 매일 밤 아침까지 빛났는지 아무도 모른다 그동안 어부들은 차가운 해안에서 배를 기다리고 있었다 그리고 바람이 불었다",
    "zh": "没有人知道为什么那座古老的灯塔每天晚上一直亮到早晨而渔民们在寒冷的海岸边等待着船只",
    "th": "ไม่มีใครรู้ว่าทำไมประภาคารเก่าจึงส่องแสงทุกคืนจนถึงเช้า",
}


@pytest.mark.parametrize("lang", SCRIPTS)
def test_passages_in_other_scripts(spark, lang):
    text = SCRIPTS[lang]
    spaced = " " in text
    words = text.split() if spaced else regex.findall(r"\X", text)
    join = " " if spaced else ""
    said = join.join(words[2:16]).upper()
    cue = lambda *parts: "\n\n".join(f"{i}\n00:00:0{i},000 --> 00:00:0{i},900\n{p}" for i, p in enumerate(parts, 1))
    docs = [
        (1, cue("Hello.", "— " + join.join(words[2:8]) + ",", "<i>" + join.join(words[8:14]) + "</i> [музыка]", join.join(words[14:16]))),
        (2, cue("Hello.", join.join(words[2:10]))),
        (3, said),
        (4, cue(*SCRIPTS.values()).replace(text, "")),
    ]
    df, items = spark.createDataFrame(docs, DOC), spark.createDataFrame([(7, "s", text), (8, "s", "zzz")], ITEM)
    found = leaked_passages(df, items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 7), (3, 7)}
    at = next(r for r in found if r.doc_id == 3)
    assert said[at.start : at.end] == said


def test_a_misreading_in_every_fourth_word_leaves_a_seed(spark):
    item = "the old door dared nobody who sailed around dark wooden yards and held clay dust under hard ground".split()
    said = [w.replace("d", "cl", 1) if i % 4 == 2 and len(w) > 3 else w for i, w in enumerate(item)]
    assert said != item
    docs = spark.createDataFrame([(1, " ".join(said)), (2, " ".join(item[:11]))], DOC)
    assert [(r.doc_id, r.item_id) for r in leaked_pairs(docs, spark.createDataFrame([(1, "s", " ".join(item))], ITEM)).collect()] == [(1, 1)]


def test_long_brackets_end_with_their_cue(spark):
    rng = random.Random(3)
    item = rng.sample(WORDS, 14)
    a, b = " ".join(item[:7]), " ".join(item[7:])
    noise = "[" + "wind howls over the roof " * 20 + "]"
    cue = lambda *parts: "\n\n".join(f"{i}\n00:00:0{i},000 --> 00:00:0{i},900\n{p}" for i, p in enumerate(parts, 1))
    docs = spark.createDataFrame([(1, cue(f"{a}\n{noise}", b)), (2, cue(f"(oh {a}", f"{b} oh)")), (3, cue(a, "said she", b))], DOC)
    assert {r.doc_id for r in leaked_pairs(docs, spark.createDataFrame([(1, "s", " ".join(item))], ITEM)).collect()} == {1, 2}


@pytest.mark.parametrize("seed", range(6))
def test_pairs_equal_brute_force(spark, seed):
    """Against word lists of every pair, compared at every alignment."""
    rng = random.Random(seed)
    pool = WORDS[: 6 + 6 * seed]
    items = [[rng.choice(pool) for _ in range(rng.randrange(8, 24))] for _ in range(12)]
    docs = []
    for _ in range(30):
        words = [rng.choice(pool) for _ in range(30)]
        if rng.random() < 0.6:
            part = rng.choice(items)
            a = rng.randrange(len(part))
            words[10:10] = part[a : a + rng.randrange(6, 24)]
        docs.append(words)

    def longest(doc, item):
        best = 0
        for shift in range(-len(item), len(doc)):
            run = 0
            for k, w in enumerate(item):
                run = run + 1 if 0 <= shift + k < len(doc) and doc[shift + k] == w else 0
                best = max(best, run)
        return best

    want = {(d, i) for d, doc in enumerate(docs) for i, item in enumerate(items) if longest(doc, item) >= 12}
    got = leaked_pairs(spark.createDataFrame([(d, cues(w, rng)) for d, w in enumerate(docs)], DOC), spark.createDataFrame([(i, f"s{i}", " ".join(w)) for i, w in enumerate(items)], ITEM))
    assert {tuple(r) for r in got.collect()} == want
