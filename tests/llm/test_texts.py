import datetime as dt
import pickle

import numpy as np
import pyarrow as pa
import pytest

from spindle.llm.encodings import PAIRS, EncodingModel, Tally, codes_of, garbled, garbled_documents, restored
from spindle.llm.scanned import clean_scans

T0 = dt.datetime(2024, 1, 1)
CLEAN = {
    "zh": ["留种田若不清除病残体并深埋，第二年的基数会成倍增加。", "已经倒伏的植株无法恢复，应带出田外集中处理。", "农户应优先深沟高畦排水，药剂只在受害率超过三成时作为补充。"],
    "fr": ["Après la récolte, il faut brûler les résidus infectés et arroser modérément la parcelle.", "L’excès d’humidité favorise la maladie ; les taches brunâtres s’élargissent près des nervures."],
    "ru": ["Растительные остатки следует убрать с поля и глубоко закопать.", "При высокой влажности болезнь распространяется за десять дней."],
    "en": ["Plants that collapse cannot recover and should be carried out of the field."],
}
TEXTS = [(k, t) for k, ts in CLEAN.items() for t in ts]


def corpus():
    out = []
    for i in range(240):
        k, t = TEXTS[i % len(TEXTS)]
        out.append(t + " " + TEXTS[(i * 3 + len(CLEAN[k])) % len(TEXTS)][1] if k in ("fr", "en") else t)
    return out


@pytest.fixture(scope="module")
def model():
    bad = [garbled(CLEAN["zh"][0], ("utf-8", "cp1252")), garbled(CLEAN["fr"][0], ("utf-8", "latin-1"))]
    return EncodingModel(corpus() + bad)


@pytest.mark.parametrize("kind, pair", [("zh", ("utf-8", "cp1252")), ("zh", ("gb18030", "latin-1")), ("zh", ("utf-8", "gb18030")), ("zh", ("gb18030", "big5")), ("fr", ("utf-8", "latin-1")), ("ru", ("koi8-r", "cp1251")), ("ru", ("utf-8", "cp1251")), ("fr", ("cp1252", "utf-8")), ("zh", ("gb18030", "utf-8"))])
def test_finds_and_restores(model, kind, pair):
    text = CLEAN[kind][1]
    bad = garbled(text, pair)
    new, found, whole = model.repair(bad)
    assert bad != text and found
    if "�" not in bad:
        assert new == text
    else:
        assert not whole


def test_stretches(model):
    bad = CLEAN["fr"][0][:40] + garbled(CLEAN["fr"][0][40:], ("utf-8", "latin-1"))
    assert model.repair(bad)[0] == CLEAN["fr"][0]


@pytest.mark.parametrize("text", [*[t for _, t in TEXTS], "", "\U0001d504\U0001d505 ሰላም ﬁ ½ &amp; &#233;", "НЕ УБРАТЬ С ПОЛЯ", "plain ascii"])
def test_clean_stays(model, text):
    assert model.repair(text) == (text, [], True)


@pytest.mark.parametrize("apart", [5, 10, 30, 60, 200])
def test_letters_far_apart(model, apart):
    # accents of one sentence, each read as two characters, with plain letters between
    plain = ("maladie foliaire sur la parcelle " * 8)[:apart]
    text = plain.join(["é", "à", "è", "é", "à"])
    bad = garbled(text, ("utf-8", "latin-1"))
    new, found, whole = model.repair(bad)
    assert found and (new == text) == whole and not any("\u0400" <= c < "\u0500" for c in new)


@pytest.mark.parametrize("wrote", ["iso2022_jp", "hz", "utf-7"])
def test_readings_of_seven_bits(wrote):
    ja = "病害が発生した場合は、直ちに取り除く必要があります。"
    zh = CLEAN["zh"][0]
    text = ja if wrote == "iso2022_jp" else zh
    m = EncodingModel(corpus() + [ja] * 20)
    bad = garbled(text, (wrote, "ascii"))
    assert bad.isascii() and m.repair(bad)[0] == text and not m.repair(CLEAN["en"][0] + " {a + b} ~ $B x")[1]


def test_recovered_means_verified(model):
    texts = [t for _, t in TEXTS]
    for pair in PAIRS:
        if "cp932" in pair[1::2]:
            continue  # it has two codes for some characters, so that two originals may look alike
        for t in texts:
            new, found, whole = model.repair(garbled(t, pair))
            if found and whole and garbled(t, (pair[0], pair[0])) == t:
                assert new == t, (pair, new)


def test_many_at_once(model, monkeypatch):
    texts = [garbled(t, p) for _, t in TEXTS for p in PAIRS[::7]] + ["", "a\nb", *corpus()[:20]]
    one = [model.repair(t) for t in texts]
    from spindle.llm import encodings

    monkeypatch.setattr(encodings, "AT_ONCE", 150)
    assert model.repair_many(texts) == one
    monkeypatch.setattr(encodings, "PLACES", 1)
    assert model.repair_many(texts) == one


def test_round_trips():
    for pair in PAIRS:
        text = "abc é ü" if pair[0] in ("cp1252", "mac-roman", "cp437", "cp850") else "абв где" if pair[0] in ("cp1251", "koi8-r", "cp866", "iso8859-5") else "中文"
        bad = garbled(text, pair[:2])
        if len(pair) == 2 and "�" not in bad and garbled(text, (pair[0], pair[0])) == text:
            assert restored(bad, pair) == text, pair


def test_documents(spark):
    bad = garbled(CLEAN["zh"][1], ("gb18030", "latin-1"))
    rows = [(i, t) for i, t in enumerate(corpus())] + [(1000, bad), (1000, bad), (None, bad), (1001, None), (1002, ""), (1003, " "), (1004, CLEAN["zh"][0] * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 key", "0 restored")
    got = garbled_documents(df, "doc_id", "text").collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1000", "1000", "None"] and all(r["restored"] == CLEAN["zh"][1] and r["recovered"] for r in got)
    assert garbled_documents(df.limit(0), "doc_id", "text").count() == 0


GREEK = ["Μετά τη συγκομιδή τα άρρωστα φύλλα μαζεύονται και θάβονται βαθιά.", "Η υγρασία ευνοεί την ασθένεια και οι κηλίδες απλώνονται γρήγορα.", "Τα νεαρά φυτά ποτίζονται νωρίς το πρωί."]


@pytest.mark.parametrize("pair", [("utf-8", "latin-1"), ("utf-8", "cp866")])
def test_all_documents_are_in_the_model(spark, pair):
    # a script that only long documents have
    rows = [(i, t) for i, t in enumerate(corpus())] + [(1000 + i, " ".join(GREEK[(i + j) % 3] for j in range(100))) for i in range(12)]
    bad = garbled(GREEK[0] + " " + GREEK[1], pair)
    got = garbled_documents(spark.createDataFrame([*rows, (2000, bad)], "doc_id long, text string"), "doc_id", "text").collect()
    assert [(r["doc_id"], r["restored"]) for r in got] == [(2000, GREEK[0] + " " + GREEK[1])]


def test_words_counted_once_are_counted_whole():
    texts = [*corpus(), *corpus()[:9], " a  b ", "\n c", "x\ty ~{ +é- \u3000中", *GREEK]
    joined = "\n" + "\n".join(texts) + "\n"
    one, other = Tally().add(texts[:100]), Tally().add(texts[100:])
    rows = pa.Table.from_batches([one.rows(), other.rows()]).group_by(["part", "key"]).aggregate([("n", "sum")]).rename_columns(["part", "key", "n"])
    for pair, (k, m) in zip([None, *PAIRS, "folded"], Tally.states(rows), strict=True):
        codes = codes_of(joined if pair is None else joined.casefold() if pair == "folded" else garbled(joined, pair))
        want = dict(zip(*(x.tolist() for x in np.unique(codes[:-1] << 21 | codes[1:], return_counts=True))))
        assert dict(zip(k.tolist(), m.tolist())) == want, pair


def test_a_model_that_was_sent(model):
    texts = [garbled(t, p) for _, t in TEXTS for p in PAIRS[::9]]
    assert pickle.loads(pickle.dumps(model)).repair_many(texts) == model.repair_many(texts)


def scans(spark, rows):
    full = [(i, f, k, t, p, x, c, T0, "clash", 0) for i, f, k, t, p, x, c in rows]
    df = spark.createDataFrame(full, "block_id long, file_path string, block_idx int, type string, page_idx int, text string, image_caption array<string>, ingested_at timestamp_ntz, noise string, unit int")
    return clean_scans(df, "test")


def test_scans(spark):
    filler = [(1000 + i, "f", 9, "text", 0, "Growers should prefer leaves and plants in winter. The leaf-mining thrips spread. 叶片出现病斑，应及时处理受害植株。", None) for i in range(30)]
    rows = [
        (1, "f", 0, "header", 0, "Field Companion", None), (2, "f", 1, "page_number", 0, "12", None), (3, "f", 1, "page_number", 1, "13 ", None),
        (10, "f", 2, "text", 1, "FIELD COMPANION · 13\nGrowers should pre-\nfer leaves.", None), (11, "f", 3, "text", 1, "- 13 -\nThe leaf-\nmining thrips spread —\nalways.", None),
        (12, "f", 4, "text", 1, "Growcrs should prefer p1ants.", None), (13, "f", 5, "text", 1, "吐片出现病斑，应及时处理受害植株。", None), (14, "f", 6, "image", 1, None, ["wlnter plants 1O days", None]),
        (15, "f", 7, "text", 1, "35%", None), (16, "f", 8, "text", 1, "14", None), (17, "f", 9, "text", 1, "H2O", None), (18, "f", 10, "text", 1, "F i e l d  C o m p a n o n", None),
        (19, "f", 11, "text", 1, None, None), (20, "f", 12, "text", 1, " ", None), (21, "f", 13, "image", 1, None, None), (22, "f", 14, "text", 1, "Growers should pre\xad\nfer leaves.", None), (10, "f", 2, "text", 1, "FIELD COMPANION · 13\nGrowers should pre-\nfer leaves.", None),
    ]
    r = scans(spark, filler + rows)
    got = sorted((x["block_id"], x["noise"]) for x in r.found.collect())
    assert got == sorted([(10, "running_header"), (10, "page_number"), (10, "hyphen_break"), (11, "page_number"), (12, "misread"), (13, "misread"), (14, "misread"), (18, "running_header"), (22, "hyphen_break")])
    text = {(x["block_id"], x["unit"]): x["text"] for x in r.repaired.collect()}
    assert text[10, 0] == "Growers should prefer leaves." and text[11, 0] == "The leaf-mining thrips spread — always." and text[12, 0] == "Growers should prefer plants."
    assert text[13, 0] == "叶片出现病斑，应及时处理受害植株。" and text[14, 0] == "winter plants 10 days"


def test_misread_characters_that_are_not_listed(spark):
    after = ["时，应排水。", "后，要松土。", "会伤根。", "易烂根。"]
    good = [(i, "f", i, "text", 0, "避免大水漫灌" + after[i % 4], None) for i in range(120)]
    bad = [(200 + i, "f", i, "text", 0, "避免大水漫罐" + after[i], None) for i in range(3)]
    natural = [(300 + i, "f", i, "text", 0, ("跳" if i < 60 else "象") + "甲为害叶片，" + after[i % 4], None) for i in range(66)]
    natural += [(400 + i, "f", i, "text", 0, "水稻象甲在田间" + after[i % 4], None) for i in range(40)]
    r = scans(spark, good + bad + natural)
    assert sorted((x["block_id"], x["noise"]) for x in r.found.collect()) == [(200 + i, "misread") for i in range(3)]
    text = {x["block_id"]: x["text"] for x in r.repaired.collect()}
    assert [text[200 + i] for i in range(3)] == ["避免大水漫灌" + a for a in after[:3]] and text[365] == natural[65][5]


def test_scans_of_an_empty_table(spark):
    r = scans(spark, [])
    assert r.found.count() == 0 and r.repaired.count() == 0


def test_paragraphs_and_numbers(spark):
    usual = [(100 + i, "f", i, "text", 0, f"间隔{10 + i}天喷一次，用量{i}.{i % 7}克。", None) for i in range(12)]
    rows = [
        (1, "f", 0, "text", 0, "每隔lO天喷一次，用量1O克，H2O不变。", None), (2, "f", 1, "text", 0, "One line\ngoes on.\n\n \nAnother para-\ngraph.\n", None),
        (3, "f", 2, "text", 0, "灌水1OO次，共l.5次；根部罐水。", None), (4, "f", 3, "text", 0, "\n\n第一段。\n\n第二段，\n继续。", None), (5, "f", 4, "text", 0, "A para-\n\ngraph.", None),
    ]
    rows += [(300 + i, "f", i, "text", 0, "The paragraph is whole.", None) for i in range(5)]
    r = scans(spark, usual + rows)
    found = {(x["block_id"], x["noise"]) for x in r.found.collect()}
    assert found == {(1, "misread"), (2, "hyphen_break"), (3, "misread")}
    text = {x["block_id"]: x["text"] for x in r.repaired.collect()}
    assert text[1] == "每隔10天喷一次，用量10克，H2O不变。" and text[2] == "One line goes on.\n\nAnother paragraph." and text[3] == "灌水100次，共1.5次；根部罐水。"
    assert text[4] == "第一段。\n\n第二段，继续。" and text[5] == "A para-\n\ngraph."


def test_titles_of_any_length(spark):
    long = "The " + "Very " * 60 + "Long Title"
    rows = [(1, "f", 0, "header", 0, long, None), (2, "f", 1, "header", 0, "目录", None), (3, "f", 2, "header", 0, None, None), (4, "f", 3, "header", 0, "12", None)]
    rows += [(10, "f", 4, "text", 1, long.replace("Long", "Lon") + "\nsaid here.", None), (11, "f", 5, "text", 1, "目录\n正文。", None), (12, "f", 6, "text", 1, "目\n正文。", None), (13, "f", 7, "text", 1, long.replace("Long Title", "Lo Title") + "\nx y.", None)]
    r = scans(spark, rows)
    assert {(x["block_id"], x["noise"]) for x in r.found.collect()} == {(10, "running_header"), (11, "running_header")}


def test_halves_find_every_string_within_one_edit(spark):
    from pyspark.sql import functions as F

    from spindle.llm.scanned import halves, near_halves

    words = ["abcd", "abce", "abc", "abcde", "xabcd", "acd", "dcba", "ab", "ac", "甲乙丙丁戊", "甲乙丁戊", "甲丙乙丁戊", "abcdabcd", "abcabcd", "a", ""]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    left = df.filter("w <> ''").select("w", F.explode(near_halves(F.col("w"))).alias("h"))
    right = df.filter("w <> ''").select(F.col("w").alias("t"), F.explode(halves(F.col("w"), F.length("w"))).alias("h"))
    got = {(r["w"], r["t"]) for r in left.join(right, "h").collect()}
    edit = {(r["a"], r["b"]): r["d"] for r in df.select(F.col("w").alias("a")).crossJoin(df.select(F.col("w").alias("b"))).withColumn("d", F.levenshtein("a", "b")).collect()}
    assert all((a, b) in got for (a, b), d in edit.items() if a and b and d <= (1 if len(b) >= 4 else 0))


def test_words_with_many_errors(spark):
    from spindle.llm.scanned import latin_corrections

    long = "incomprehensibilities"
    bad = long.replace("i", "1").replace("o", "0").replace("e", "c")
    df = spark.createDataFrame([(long, 40), (bad, 1), ("x" * 60 + "long", 30), ("x" * 60 + "1ong", 1)], "word string, n long")
    assert {tuple(r) for r in latin_corrections(df).collect()} == {(bad, long), ("x" * 60 + "1ong", "x" * 60 + "long")}
