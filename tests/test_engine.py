"""The engine's own queries against their SQL."""

import duckdb
import pytest

from lexigrove.operators import pairs, segment, splits
from lexigrove.plans import engine


@pytest.fixture(scope="module")
def duck():
    return duckdb.connect()


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query(spark, duck, name):
    df = engine.QUERIES[name](spark, "")
    want = duck.sql(engine.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    show = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert show(df.collect()) == show(want.select(*[f'"{c}"' for c in df.columns]).fetchall())


def word(text, *seqs, at=0, score=10, **kw):
    return pairs.Word(at, at + len(text), text, frozenset(seqs), frozenset(kw.pop("pos", ())), kw.pop("solid", True), score=score, **kw)


def test_followed():
    """Words that need something before them go where it is."""
    iru, other, tsu, noun = word("いる", 1577980, at=1), word("いる", 5, at=1, score=8), word("つ", 2221640), word("本", 9)
    assert pairs.followed((noun,), (iru, other)) == [((noun,), (iru, other))]
    assert pairs.followed((tsu,), (iru, other)) == [((tsu,), (other,))]
    assert pairs.followed((noun, tsu), (iru, other)) == [((noun,), (iru,)), ((noun, tsu), (other,))]
    assert pairs.followed(None, (iru, other)) == [(None, (iru, other))]
    karasu, wo = word("からす", 2087020, at=1), word("を", 2029010)
    assert pairs.followed(None, (karasu,)) == [] and pairs.followed((wo,), (karasu,)) == [((wo,), (karasu,))]
    assert pairs.followed((noun,), (karasu,)) == []
    bad = word("食べとき", 13, at=1, parts=(13, 7), end_text="とき")
    assert pairs.followed((noun,), (bad,)) == [] and pairs.followed(None, (bad, other)) == [(None, (other,))]
    hajimeru = word("はじめる", 1342560, at=2)
    assert pairs.followed((word("読み", 7, conj=frozenset({13})),), (hajimeru,)) != []
    assert pairs.followed((word("読む", 7),), (hajimeru,)) == []


def test_options():
    noun, plain, wa = word("世界", 1, pos=["n"]), word("世界", 2, score=9), word("は", 2028920, at=2, solid=False, score=5)
    found = pairs.options((noun, plain), (wa,))
    assert found[0] == ((noun, plain), (wa,), 0) and ((noun,), (wa,), 14) in found
    assert found[0][2] == 0 and pairs.options((noun,), (word("は", 2028920, at=5, solid=False),)) == [((noun,), (word("は", 2028920, at=5, solid=False),), 0)]


def test_search_narrows_lists():
    """The path keeps the words of a list that the pair allows."""
    tsu, noun = word("つ", 2221640, score=20), word("つ", 9, score=18)
    iru = word("いる", 1577980, at=1, score=30)
    lists = [(0, 1, (tsu, noun)), (1, 3, (iru,))]
    found = segment.search(3, lists, 1, lambda words: [words], pairs.options)
    assert found == [(48, [(0, (noun,)), (1, (iru,))])]


def test_marks():
    assert splits.insert_marks("abc", [("|", 1), ("*", 1), ("!", 3), ("?", 9)]) == "a|*bc!"
    blocks = [("私", "わたし"), ("は", "は"), ("本", "ほん")]
    assert [splits.moved(blocks, i) for i in range(4)] == [1, 3, 4, 6]
    assert splits.parsed_form("私 は 本")[0] == "私は本"


def test_sinks(spark, tmp_path):
    from lexigrove.sources.stores import write_documents

    made = spark.createDataFrame([(1, "watashi wa")], "id int, output string")
    write_documents(made, str(tmp_path / "text"), "romanize")
    assert [r.value for r in spark.read.text(str(tmp_path / "text")).collect()] == ["watashi wa"]
    write_documents(spark.createDataFrame([(1, '{"tokens":[]}')], "id int, output string"), str(tmp_path / "json"), "json-v2")
    row = spark.read.schema("key int, document struct<tokens:array<string>>").json(str(tmp_path / "json")).first()
    assert row.key == 1 and row.document.tokens == []


def test_best_cuts():
    """Many runs at once, against the path search of one."""
    import random

    import numpy as np

    from lexigrove.plans import flagship

    rng = random.Random(2)
    for width in (1, 3, 7):
        runs = [[(a, b, rng.randint(1, 90)) for a in range(width) for b in range(a + 1, width + 1) if rng.random() < 0.5] for _ in range(30)]
        flat = [(k, *s) for k, segments in enumerate(runs) for s in segments] + [(29, 0, 0, 0)]
        got = flagship.best_cuts(width, *(np.array(x) for x in zip(*flat, strict=True)), 3)
        score, pieces, gaps = flagship.read_cut(got, width)
        for k, segments in enumerate(runs):
            want = segment.best_paths(width, sorted(segments), 3)
            assert score[k][: len(want)].tolist() == [v for v, _ in want]
            own = [sorted(segments)[i] for i in want[0][1]]
            ties = [v for v, _ in segment.best_paths(width, sorted(segments), 2)]
            if len(ties) < 2 or ties[0] != ties[1]:
                assert (pieces[k][0], gaps[k][0]) == (len(own), width - sum(b - a for a, b, _ in own))
