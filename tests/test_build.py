"""Building, correcting and showing a lexicon; streams."""

import json
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from lexicon import ENTRIES  # noqa: E402

from lexigrove.operators import conjugation, documents, kanji, patches, segment, senses  # noqa: E402
from lexigrove.sources import dictionary_xml as xml  # noqa: E402
from lexigrove.sources.lexicon import Lexicon, assemble  # noqa: E402
from lexigrove.streaming.segment import segment_stream  # noqa: E402

SOURCE = """<?xml version="1.0"?><d>
<entry><ent_seq>1000</ent_seq><k_ele><keb>飲む</keb><ke_pri>news1</ke_pri><ke_pri>nf05</ke_pri></k_ele>
<r_ele><reb>のむ</reb><re_pri>ichi1</re_pri></r_ele><sense><pos>v5m</pos><gloss>to drink</gloss><gloss>to swallow</gloss></sense>
<sense><misc>uk</misc><gloss>to accept</gloss></sense></entry>
<entry><ent_seq>1001</ent_seq><r_ele><reb>ここ</reb><re_nokanji/></r_ele><r_ele><reb>こっこ</reb><re_inf>ok</re_inf></r_ele>
<sense><pos>pn</pos><gloss>here</gloss></sense></entry></d>"""

CHARACTERS = """<k><character><literal>飲</literal><misc><grade>3</grade><stroke_count>12</stroke_count></misc>
<reading_meaning><rmgroup><reading r_type="ja_on">イン</reading><reading r_type="ja_kun">の.む</reading><reading r_type="ja_kun">-の.み</reading>
<reading r_type="pinyin">yin3</reading><meaning>drink</meaning></rmgroup></reading_meaning></character></k>"""


@pytest.fixture(scope="module")
def lexicon(spark):
    return Lexicon.of(spark, assemble(ENTRIES))


def test_xml(spark, tmp_path):
    (tmp_path / "d.xml").write_text(SOURCE)
    lex = xml.lexicon_of(xml.read_entries(spark, str(tmp_path / "d.xml")))
    get = lambda df, *c: [tuple(r) for r in df.orderBy("ordinal").select(*c).collect()]
    assert get(lex.entry, "seq", "n_kanji", "n_kana", "primary_nokanji") == [(1000, 1, 1, False), (1001, 0, 2, True)]
    assert get(lex.kanji_text, "id", "text", "common", "common_tags", "best_kana") == [(1, "飲む", 5, "[news1][nf05]", "のむ")]
    assert get(lex.kana_text, "seq", "text", "ord", "common", "best_kanji") == [(1000, "のむ", 0, 0, "飲む"), (1001, "ここ", 0, None, None)]
    assert get(lex.gloss, "sense_id", "text", "ord") == [(1, "to drink", 0), (1, "to swallow", 1), (2, "to accept", 0), (3, "here", 0)]
    assert get(lex.sense_prop, "tag", "text") == [("pos", "v5m"), ("misc", "uk"), ("pos", "pn")]
    text = spark.createDataFrame([('<!ENTITY v5m "Godan verb"> &v5m; &amp;',)], "s string").select(xml.plain_entities(F.col("s"))).first()[0]
    assert text == '<!ENTITY v5m "v5m"> v5m &amp;'


def test_characters(spark, tmp_path):
    (tmp_path / "k.xml").write_text(CHARACTERS)
    rows = xml.readings_of(xml.read_characters(spark, str(tmp_path / "k.xml"))).collect()
    assert sorted((r.type, r.text, r.okurigana or "", r.suffixp) for r in rows) == [("ja_kun", "の", "み", True), ("ja_kun", "の", "む", False), ("ja_on", "イン", "", False)]


def test_wards(spark, tmp_path):
    (tmp_path / "w.csv").write_text("1,札幌市,さっぽろし\n2,北区,きたく\n3,仙台市,せんだいし\n4,泉区,いずみく\n")
    rows = xml.read_wards(spark, str(tmp_path / "w.csv")).orderBy("id").collect()
    assert [(r.city, r.text) for r in rows] == [(None, "札幌市"), ("札幌市", "北区"), (None, "仙台市"), ("仙台市", "泉区")]


def test_conjugation(spark, lexicon, tmp_path):
    header = "pos\tconj\tneg\tfml\tonum\tstem\tokuri\teuphr\teuphk\tpos2\n"
    rules = ["31\t2\tf\tf\t1\t1\tだ\tん\tん\t", "31\t2\tt\tf\t1\t1\tまなかった\t\t\t", "31\t3\tf\tf\t1\t1\tで\tん\tん\t", "31\t1\tf\tf\t1\t1\tむ\t\t\t"]
    (tmp_path / "r.tsv").write_text(header + "\n".join(rules) + "\n")
    index = spark.createDataFrame([(31, "v5m")], "pos int, kw string")
    # Only rows that conjugate: the verb 読む.
    made = conjugation.forms(lexicon, xml.read_rules(spark, str(tmp_path / "r.tsv")), index)
    got = {(r.conj, r.neg, r.text, r.source) for r in made.where("seq = 7").collect()}
    # The ending gives way to the sound change: one more character is cut.
    assert (2, True, "読まなかった", "読む") in got and (3, None, "んで", "読む") in got and not any(c == 1 for c, *_ in got)
    cells = conjugation.derived_entries(made).where("seq = 7").select("conj", "neg", "derived").distinct().collect()
    assert len({r.derived for r in cells}) == len(cells) == 3
    names = spark.createDataFrame([(3, "Conjunctive (~te)")], "conj_type int, name string")
    assert conjugation.descriptions(lexicon, names).first()["chain"] == "[v5m] Conjunctive (~te) Affirmative Plain"


def test_senses(spark, lexicon):
    keys = spark.createDataFrame([(12,), (9,)], "seq int")
    text = {r.seq: r.text for r in senses.sense_text(senses.senses(lexicon, keys)).collect()}
    assert text[12] == "1. [n] book\n2. [ctr] counter for long things"
    entry = senses.entry_text(lexicon, keys).where("seq = 9").first()
    assert entry.reading == "有る 【ある】" and entry.text == "1. [v5r-i] to be"


def test_documents(spark, lexicon):
    texts = spark.createDataFrame([(1, "私は世界!")], "id int, text string")
    tokens = segment.tokens(texts, segment.word_features(lexicon))
    out = lambda form: documents.render(tokens, lexicon, "id", form).first()["output"]
    assert out("romanize") == "watashi ha sekai!"
    assert "世界 【せかい】\n1. [n] the world; society" in out("romanize-info")
    first = json.loads(out("json-v1"))
    assert first[2][0] == "sekai" and first[2][1]["score"] == 325 and first[3] == "!"
    second = json.loads(out("json-v2"))
    assert [t["token"] for t in second["tokens"]] == ["私", "は", "世界", "!"] and second["entries"]["1"][0]["pos"] == "[n]"
    with pytest.raises(ValueError, match="no format"):
        out("pdf")


def test_furigana(spark):
    readings = spark.createDataFrame([("日", "にち", "ja_on"), ("日", "ひ", "ja_kun"), ("本", "ほん", "ja_on"), ("人", "ひと", "ja_kun"), ("学", "がく", "ja_on"), ("校", "こう", "ja_on")], "literal string, text string, type string")
    words = spark.createDataFrame([("学校", "がっこう"), ("人々", "ひとびと"), ("お日さま", "おひさま"), ("大人", "おとな"), ("日x", "に")], "text string, kana string")
    aligned = kanji.furigana(words, readings)
    got = {r.text: r.blocks and [tuple(b) for b in r.blocks] for r in aligned.collect()}
    assert got["学校"] == [("学", "がっ", "ja_on"), ("校", "こう", "ja_on")]
    assert got["人々"] == [("人", "ひと", "ja_kun"), ("々", "びと", "ja_kun")]
    assert got["お日さま"] == [("お", "お", "kana"), ("日", "ひ", "ja_kun"), ("さま", "さま", "kana")]
    assert [b[2] for b in got["大人"]] == ["irregular"] and got["日x"] is None
    stats = {(r.literal, r.reading): r.share for r in kanji.reading_statistics(aligned).collect()}
    assert stats["学", "がっ"] == "100.00%"


def test_patches(spark, lexicon):
    df = spark.createDataFrame
    fixed = patches.apply(
        lexicon,
        [
            patches.add_readings("kana", df([(2, "やまと", None, False), (2, "にほん", 1, False)], "seq int, text string, common int, conjugate_p boolean")),
            patches.delete_readings("kana", df([(2, "にほん")], "seq int, text string")),
            patches.set_column("kanji_text", df([(1, "世界", 9)], "seq int, text string, new int"), "common"),
            patches.add_sense_props(df([(1, 0, "misc", "uk"), (1, 0, "pos", "n")], "seq int, sense_ord int, tag string, text string")),
            patches.delete_conjugations(df([(1,)], "id int")),
        ],
    )
    kana = fixed.kana_text.where("seq = 2").orderBy("ord").collect()
    assert [(r.text, r.ord) for r in kana] == [("にっぽん", 0), ("やまと", 1)]
    assert fixed.kanji_text.where("seq = 1").first()["common"] == 9
    assert fixed.entry.where("seq = 2").first()["n_kana"] == 2
    assert sorted(r.text for r in fixed.sense_prop.where("seq = 1").collect()) == ["n", "uk"]
    assert fixed.kana_text.where("seq = 10000001").count() == 0 and fixed.entry.count() == lexicon.entry.count() - 1
    ids = [r.id for r in fixed.kana_text.collect()]
    assert len(ids) == len(set(ids))


def test_stream(spark, lexicon, tmp_path):
    spark.createDataFrame([(1, "世界"), (2, "日本語")], "id int, text string").write.json(str(tmp_path / "in"))
    features = segment.word_features(lexicon).cache()
    stream = spark.readStream.schema("id int, text string").json(str(tmp_path / "in"))
    sink = lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / "out" / str(n)))
    segment_stream(stream, features, sink, str(tmp_path / "check")).awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out" / "0")).collect()
    assert {(r.id, r.romaji) for r in rows} == {(1, "sekai"), (2, "nihongo")}
