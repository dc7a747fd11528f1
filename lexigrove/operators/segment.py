"""Segmentation: text to the best sequences of words.

spans -> candidates (one join with the lexicon) -> score (integer columns) -> cull
(a window) -> best paths (one row for each run, in an Arrow function) -> tokens.
Runs are split out of texts first, so the unit of work is short however long the text.
Equal runs are solved once.
"""

from __future__ import annotations

import bisect
import functools
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import tables as t
from ..functions import text as tx
from ..functions.romaji import DEFAULT, romanize
from ..sources.lexicon import Lexicon
from ..sources.tables import settled
from . import compounds, pairs
from .lookups import Lookups

# Fixed values of the scores.
LONGEST_WORD = 50
GAP = -500
CUTOFF = 5
STRONG, WEAK = (1, 8, 24, 40, 60), (1, 4, 9, 16, 25, 36)
TAIL, LONG_TAIL = (4, 9, 16, 24), (4, 12, 18, 24)
COPULAE = (2089020,)
#: Entries that a break inside a run of kanji costs nothing.
NO_BREAK_COST = (1169870, 1198360, 1277450, 2028980, 1423000, 1164690, 1587040, 2827864)
#: Words whose characters are all apart, and words that are never cut.
ALWAYS_BREAK, NEVER_BREAK = ("です",), ("日置",)
WEAK_FORMS = (51, 52, 53, 54)
BEAM = 5


def runs(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Texts to runs: the columns of ``texts``, run_no, is_word, run."""
    parts = tx.basic_split(tx.normalize(F.col(text_col)))
    split = texts.select("*", F.posexplode(parts).alias("run_no", "_part"))
    return split.select(*texts.columns, "run_no", F.col("_part.matched").alias("is_word"), F.col("_part.text").alias("run"))


def sticky_positions(run: Column) -> Column:
    """Positions that no word begins or ends at: after a small tsu, before small kana."""
    small = "[" + "".join("".join(t.CLASSES[c]) for c in (*t.SMALL, t.LONG, t.REPEAT, t.REPEAT_VOICED)) + "]"
    morae = "[" + "".join("".join(t.CLASSES[c]) for c in t.MORAE) + "]"
    n = F.char_length(run)

    def sticks(at: Column) -> Column:
        before, here = F.substring(run, at, F.lit(1)), F.substring(run, at + 1, F.lit(1))
        name = tx.char_class_of(here)
        ends = (at == n - 1) & ((name == t.LONG) | tx.long_vowel_modifier(name, before))
        return (before.rlike("[っッ]") & here.rlike(morae)) | (here.rlike(small) & ~F.coalesce(ends, F.lit(False)))

    inner = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(inner, sticks)


def spans(words: DataFrame) -> DataFrame:
    """(run, start, stop, text) of all substrings of distinct runs that may be words."""
    n = F.char_length("run")
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~F.array_contains("_sticky", i))
    stops = F.filter(F.sequence(F.col("start") + 1, F.least(n, F.col("start") + LONGEST_WORD)), lambda i: ~F.array_contains("_sticky", i))
    return (
        words.select("run", sticky_positions(F.col("run")).alias("_sticky"))
        .select("run", "_sticky", F.explode(starts).alias("start"))
        .select("run", "start", F.explode(stops).alias("stop"))
        .withColumn("text", F.expr("substring(run, start + 1, stop - start)"))
    )


def word_features(lexicon: Lexicon) -> DataFrame:
    """One row for each form in the lexicon, with all that its score needs.

    It depends on the lexicon only: write it once, join it ever after.
    """
    look = Lookups(lexicon)
    forms = lexicon.kanji_text.select(F.lit("kanji").alias("kind"), "id", "seq", "text", "ord", "common", "nokanji", F.col("best_kana").alias("kana"), "ordinal").unionByName(
        lexicon.kana_text.select(F.lit("kana").alias("kind"), "id", "seq", "text", "ord", "common", "nokanji", F.col("text").alias("kana"), "ordinal")
    )
    seqs = lexicon.entry.select("seq")
    links = lexicon.conjugation.join(lexicon.conj_prop.select(F.col("conj_id").alias("id"), "conj_type", "pos", "neg", "fml"), "id")
    source = lexicon.conj_source_reading.select(F.col("conj_id").alias("id"), "text", "source_text")
    texts = lexicon.kanji_text.select("seq", "text", "common", "ord").unionByName(lexicon.kana_text.select("seq", "text", "common", "ord"))
    parent = texts.select(F.col("seq").alias("from"), F.col("text").alias("source_text"), F.col("common").alias("source_common"), F.col("ord").alias("source_ord"))
    link = F.struct("from", "via", "conj_type", "pos", "neg", "fml", "source_text", "source_common", "source_ord")
    conj = links.join(source, "id").join(parent, ["from", "source_text"], "left").groupBy("seq", "text").agg(F.sort_array(F.collect_list(link)).alias("conj"))
    family = lexicon.conjugation.select("seq", F.col("from").alias("member")).unionByName(seqs.select("seq", F.col("seq").alias("member"))).distinct()
    pos = look.used_pos(seqs).select(F.col("seq").alias("member"), F.col("pos").alias("p"))
    posi = family.join(pos, "member").groupBy("seq").agg(F.array_sort(F.collect_set("p")).alias("posi"))
    usually = look.usually_kana_senses(seqs).join(lexicon.sense.select(F.col("id").alias("sense_id"), F.col("ord").alias("sense_ord")), "sense_id")
    usually = usually.groupBy("seq").agg(F.min("sense_ord").alias("kana_sense"))
    archaic = look.archaic_seqs().withColumn("archaic", F.lit(True))
    return (
        forms.join(lexicon.entry.drop("ordinal"), "seq")
        .join(conj, ["seq", "text"], "left")
        .join(posi, "seq", "left")
        .join(usually, "seq", "left")
        .join(archaic, "seq", "left")
        .withColumn("archaic", F.coalesce("archaic", F.lit(False)))
        .withColumn("posi", F.coalesce("posi", F.array().cast("array<string>")))
        .withColumn("conj", F.coalesce("conj", F.array().cast("array<struct<from:int,via:int,conj_type:int,pos:string,neg:boolean,fml:boolean,source_text:string,source_common:int,source_ord:int>>")))
    )


def length_weight(n: Column, table: tuple[int, ...]) -> Column:
    last = table[-1] // len(table)
    return F.when((n > 0) & (n <= len(table)), F.get(F.array(*map(F.lit, table)), n - 1)).otherwise(n * last)


def analysed(df: DataFrame, final: Column, whole: Column | None = None, factor: Column | None = None, constant: Column | None = None) -> DataFrame:
    """Rows of word_features with ``_a``: score, solid (kanji or katakana), primary, common and long
    of a plain word, its entries and types of conjugation.  ``final``: it ends the run.

    As the first part of a compound: ``whole`` is its text; the suffixes add ``factor`` times
    the word's own worth and the length added, and ``constant``.
    A counter with its number (its only part of speech is ctr) is worth 5 at least.

    In steps of columns: what a step uses more than once is computed once.
    """
    root_only = whole is None
    columns, c = df.columns, lambda name: F.col(f"_x_{name}")

    def step(**made: Column) -> None:
        nonlocal df
        df = df.withColumns({f"_x_{k}": v for k, v in made.items()})

    conj = F.col("conj")
    step(
        final=final, n=F.greatest(tx.mora_length(F.col("text")), F.lit(1)), n_kanji=tx.count_class(F.col("text"), "kanji"), kanji=F.col("kind") == "kanji",
        derived=F.size(conj) > 0, kana_first=F.col("kana_sense").isNotNull(), particle=F.array_contains("posi", "prt"), pronoun=F.array_contains("posi", "pn"),
        katakana=(F.col("kind") != "kanji") & (tx.count_class(F.col("text"), "katakana_uniq") > 0), own_common=F.col("common").isNotNull(),
    )
    step(secondary=c("derived") & F.forall(conj, lambda x: x["via"].isNotNull()))
    step(used=F.when(c("secondary"), conj).otherwise(F.filter(conj, lambda x: x["via"].isNull())))
    weak = lambda x: x["conj_type"].isin(*WEAK_FORMS) | ((x["conj_type"] == 9) & F.coalesce(x["neg"], F.lit(False)))
    step(
        types=F.array_distinct(F.transform(c("used"), lambda x: x["conj_type"])), sources=F.filter(c("used"), lambda x: x["source_ord"].isNotNull()),
        plain=F.col("root_p") | F.lit(not root_only) | ~F.forall(c("used"), weak),
        copula=F.col("seq").isin(*COPULAE) | F.exists(c("used"), lambda x: x["from"].isin(*COPULAE)),
        back=c("derived") & ~((F.col("ord") == 0) & c("own_common")),
    )
    has = lambda kind: F.array_contains(c("types"), kind)
    step(
        common_p=c("own_common") | (c("back") & F.exists(c("sources"), lambda x: x["source_common"].isNotNull())),
        common=F.when(c("own_common"), F.col("common")).otherwise(0),
        ord=F.when(c("back") & (F.size(c("sources")) > 0), F.least("ord", F.array_min(F.transform(c("sources"), lambda x: x["source_ord"])))).otherwise(F.col("ord")),
        popular=c("own_common") & (F.col("common") > 0) & (F.col("common") < 10),
    )
    threshold = (
        F.when(c("kanji") & ~c("kana_first") & ((F.col("root_p") & ~c("derived")) | (F.lit(not root_only) & has(13))), 2)
        .when(c("popular"), 2)
        .when((has(3) | has(9)) & F.lit(root_only), 4)
        .otherwise(3)
    )
    step(long=c("n") > threshold)
    plain_kana = c("kana_first") & c("plain") & ~c("kanji") & (~F.col("primary_nokanji") | F.col("nokanji"))
    first_form = ((c("ord") == 0) | c("copula")) & (c("kanji") | c("plain")) & ((c("kanji") & ~c("kana_first")) | (c("common_p") & c("pronoun")) | (F.col("n_kanji") == 0))
    later_kana = c("kana_first") & c("kanji") & (c("ord") == 0) & (F.col("kana_sense") > 0)
    step(primary=~F.col("archaic") & (plain_kana | first_form | later_kana), interjection=~c("long") & (F.size("posi") == 1) & (F.get("posi", F.lit(0)) == "int"))
    first = F.when(
        c("primary"),
        F.when(c("long"), 10).when(c("secondary") & ~c("kanji"), 2).when(c("common_p") & c("plain"), 5).when(c("kana_first") | (F.col("n_kanji") == 0), 3).otherwise(2),
    ).otherwise(0)
    semi_final = F.col("seq").isin(*pairs.SEMI_FINAL_PARTICLES)
    closes = c("final") & ~F.col("seq").isin(*pairs.NON_FINAL_PARTICLES)
    closing = F.when(closes & c("primary"), 5).when(closes & semi_final, 2).otherwise(0)
    step(total1=F.lit(1) + first + F.when(c("particle") & (c("final") | ~semi_final), 2 + F.when(c("common_p"), 2 + c("n")).otherwise(0) + closing).otherwise(0))
    step(
        ladder=F.when(c("secondary") & F.lit(root_only), F.when(c("kanji") & c("primary"), 4).otherwise(2))
        .when(
            c("long") | c("copula") | (F.col("root_p") & (c("kanji") | (c("primary") & (c("n") > 2)))),
            F.when(c("common") == 0, 10).when(~c("primary"), F.greatest(15 - c("common"), F.lit(10))).otherwise(F.greatest(20 - c("common"), F.lit(10))),
        )
        .when(c("kanji"), 8)
        .when(c("primary"), 4)
        .when((c("n") > 2) | c("popular"), 3)
        .otherwise(2)
    )
    lowered = c("ladder") - F.when((c("ladder") >= 10) & has(10), 4).otherwise(0)
    step(total2=c("total1") + F.when(c("common_p") & ~(c("particle") | ~c("plain") | c("interjection")), lowered).otherwise(0))
    step(total3=F.when(c("long"), F.greatest(c("n"), c("total2"))).otherwise(c("total2")))
    raised = F.greatest(F.when(F.col("archaic"), 3).otherwise(5), c("total3")) + F.when(c("long") & ((c("n_kanji") > 1) | (c("n") > 4)), 2).otherwise(0)
    step(total4=F.when(c("kanji"), raised).otherwise(c("total3")), solid=c("kanji") | c("katakana"))
    counts = (F.size("posi") == 1) & (F.get("posi", F.lit(0)) == "ctr") & (F.size(conj) == 0)
    weight = F.when(c("solid"), length_weight(c("n"), STRONG)).otherwise(length_weight(c("n"), WEAK))
    step(total=F.when(counts, F.greatest(F.lit(5), c("total4"))).otherwise(c("total4")), weight=weight + F.when(c("n_kanji") > 1, (c("n_kanji") - 1) * 5).otherwise(0))
    step(value=c("total") * c("weight"), family=F.concat(F.array("seq"), F.transform(c("used"), lambda x: x["from"])))
    if not root_only:
        step(more=tx.mora_length(whole) - c("n"))
        tail = F.when((c("n") > 3) & c("solid"), length_weight(c("more"), LONG_TAIL)).otherwise(length_weight(c("more"), TAIL))
        step(value=c("value") + c("total") * tail + constant + c("total") * factor * c("more"))
    no_word = F.arrays_overlap(c("family"), F.array(*map(F.lit, pairs.SKIPPED))) | (~c("final") & F.col("seq").isin(*pairs.FINAL_PARTICLES))
    out = F.struct(
        F.when(no_word, 0).otherwise(c("value")).cast("int").alias("score"), c("solid").alias("solid"), c("primary").alias("primary"), c("common_p").alias("common"),
        c("long").alias("long"), c("family").alias("seqs"), F.exists(c("used"), lambda x: F.coalesce(x["neg"], F.lit(False))).alias("negative"), c("types").alias("types"),
    )
    return df.select(*columns, out.alias("_a"))


def kanji_breaks(placed: DataFrame) -> DataFrame:
    """(run, breaks): positions inside the runs of kanji of words that begin where the run or
    another word ends.  placed: run, start, stop, text of all words."""
    spans_ = placed.select("run", "start", "stop", "text").distinct()
    ends = placed.select("run", F.col("stop").alias("start")).distinct().withColumn("_met", F.lit(True))
    reached = spans_.join(ends, ["run", "start"], "left").where("start = 0 OR _met")
    inner = F.when(F.col("text").isin(*ALWAYS_BREAK) & (F.char_length("text") > 1), F.expr("sequence(start + 1, stop - 1)")).when(~F.col("text").isin(*NEVER_BREAK), F.transform(tx.kanji_boundaries(F.col("text")), lambda i: i + F.col("start")))
    return reached.select("run", F.explode(inner).alias("at")).groupBy("run").agg(F.array_sort(F.collect_set("at")).alias("breaks"))


def break_cost(score: Column, at_start: Column, at_stop: Column, text: Column, posi: Column, seqs: Column) -> Column:
    """The score of a word that begins or ends inside a run of kanji: half and a bonus, CUTOFF at least."""
    only_start, only_stop = at_start & ~at_stop, at_stop & ~at_start
    any_of = lambda *pos: F.arrays_overlap(posi, F.array(*map(F.lit, pos)))
    bonus = (
        F.when(any_of("vs-s", "v5s"), 0)
        .when(only_start & any_of("num"), 5)
        .when(only_start & any_of("suf", "n-suf"), 10)
        .when(only_stop & any_of("pref"), 12)
        .otherwise(0)
    )
    spared = F.arrays_overlap(seqs, F.array(*map(F.lit, NO_BREAK_COST))) | (only_start & F.startswith(text, F.lit("す")))
    halved = F.greatest(F.lit(CUTOFF), F.ceil(score / 2).cast("int") + bonus)
    return F.when(~(at_start | at_stop) | spared | (score < CUTOFF), score).otherwise(halved)


def katakana_groups(every: DataFrame) -> DataFrame:
    """The spans that are whole runs of katakana."""
    kata = t.CHARACTER_CLASSES["katakana"]
    before, after = F.expr("substring(run, start, 1)"), F.expr("substring(run, stop + 1, 1)")
    inner = F.when(F.col("start") > 0, ~before.rlike(kata)).otherwise(F.lit(True)) & F.when(F.col("stop") < F.char_length("run"), ~after.rlike(kata)).otherwise(F.lit(True))
    return every.where(tx.in_class(F.col("text"), "katakana") & inner)


def candidates(words: DataFrame, features: DataFrame, suffixes: DataFrame | None = None, hiragana: bool = True) -> DataFrame:
    """Scored words at their places in distinct runs: at least CUTOFF and half the best of the span.

    Words of the lexicon, numbers with counters, with ``hiragana`` runs of katakana that the
    lexicon has as hiragana, and with ``suffixes`` (compounds.suffix_forms) roots with suffixes and contractions.
    """
    from .words import as_hiragana

    every = settled(spans(words))
    placed = every.join(features, "text")
    n = F.char_length("run")
    at_end = (F.col("stop") == n) | ((F.col("stop") == n - 1) & F.endswith("run", F.lit("ー")))
    simple = placed.unionByName(compounds.with_counters(placed, every))
    if hiragana:
        groups = katakana_groups(every)
        simple = simple.unionByName(groups.join(as_hiragana(groups.select("text").distinct(), features), "text"))
    if suffixes is not None:
        made = compounds.chains(every.select("text").distinct(), features, suffixes)
        at = every.select("run", "start", "stop", F.col("text").alias("whole"))
        here = at.join(made, "whole")
        short = F.size("parts") == 1
        simple = simple.unionByName(here.where(short).select(*simple.columns))
        rest = analysed(here.where(~short), F.lit(False), F.col("whole"), F.col("factor"), F.col("constant"))
        rest = rest.withColumn("end_text", F.col("last_text"))
        rest = rest.withColumns({"text": F.col("whole"), "kana": F.col("whole_kana"), "kind": F.lit("compound"), "_types": F.array_distinct(F.transform("last_conj", lambda c: c["conj_type"]))})
    scored = analysed(simple, at_end).withColumn("parts", F.array("seq")).withColumn("end_text", F.lit("")).withColumn("_types", F.col("_a.types"))
    scored = scored.withColumn("classes", F.array().cast("array<string>"))
    if suffixes is not None:
        scored = scored.unionByName(rest.select(*scored.columns))
    scored = settled(scored)
    breaks = kanji_breaks(scored)
    scored = scored.join(breaks, "run", "left")
    inside = lambda c: F.coalesce(F.array_contains("breaks", F.col(c)), F.lit(False))
    scored = scored.withColumn("score", break_cost(F.col("_a.score"), inside("start"), inside("stop"), F.col("text"), F.col("posi"), F.col("_a.seqs"))).drop("breaks")
    scored = scored.where(F.col("score") >= CUTOFF)
    best = F.max("score").over(Window.partitionBy("run", "start", "stop"))
    return scored.withColumn("_best", best).where("2 * score >= _best").drop("_best")


def search(n: int, lists: list[tuple[int, int, tuple]], beam: int, first, options) -> list[tuple[int, list[tuple[int, tuple]]]]:
    """The best ``beam`` sequences of lists of words (start, stop, words), sorted by start; words have a
    score and the best of them comes first.

    A character that no list covers costs GAP.  ``first(words)`` gives the lists that may begin
    a sequence; ``options(left, right)`` what two neighbours may become and what the pair counts.  The
    pair is worth at least one more than the better of the two.  Ties go to the sequence found
    first.  A sequence is a list of (number of the list, the words that are left of it).
    """
    kept: list[list] = [[] for _ in lists]
    top: list = []

    def offer(heap: list, value: int, path: list) -> None:
        at = bisect.bisect_right([-v for v, _ in heap], -value)
        if at < beam:
            heap.insert(at, (value, path))
            del heap[beam:]

    offer(top, GAP * n, [])
    for i, (start, stop, words) in enumerate(lists):
        for begun in first(words):
            value = GAP * start + begun[0].score
            offer(kept[i], value, [(i, begun)])
            offer(top, value + GAP * (n - stop), [(i, begun)])
        for j in range(i + 1, len(lists)):
            then, until, others = lists[j]
            if then < stop:
                continue
            for value, path in kept[i]:
                own = path[-1][1]
                for left, right, worth in options(own, others):
                    pair = max(left[0].score + right[0].score + worth, own[0].score + 1, others[0].score + 1)
                    total = value - own[0].score + pair + GAP * (then - stop)
                    longer = [*path[:-1], (i, left), (j, right)]
                    offer(kept[j], total, longer)
                    offer(top, total + GAP * (n - until), longer)
    return top


@dataclass(frozen=True)
class _Bare:
    at: int
    score: int


def best_paths(n: int, segments: list[tuple[int, int, int]], beam: int = BEAM, bonus=None) -> list[tuple[int, list[int]]]:
    """search() over segments (start, stop, score) of one word each, with ``bonus(i, j)``."""
    lists = [(start, stop, (_Bare(i, score),)) for i, (start, stop, score) in enumerate(segments)]
    pairs_ = lambda a, b: [(a, b, bonus(a[0].at, b[0].at) if bonus else 0)]
    return [(value, [i for i, _ in path]) for value, path in search(n, lists, beam, lambda words: [words], pairs_)]


def _rule_words(segment) -> tuple[pairs.Word, ...]:
    out = []
    for w in segment["words"]:
        a = w["_a"]
        out.append(
            pairs.Word(
                segment["start"], segment["stop"], w["text"], frozenset(a["seqs"]), frozenset(w["posi"]), a["solid"], a["primary"], a["common"], a["long"], a["negative"],
                tuple(w["parts"]), frozenset(w["_types"]), w["end_text"] or "", w["score"],
            )
        )
    return tuple(out)


def best_sequences(n: int, segments, beam: int) -> list[dict]:
    """search() under the rules of pairs.py: score and path, of (segment, word)."""
    lists = [(s["start"], s["stop"], _rule_words(s)) for s in segments]
    number = {(i, id(w)): k for i, (_, _, words) in enumerate(lists) for k, w in enumerate(words)}
    options = functools.cache(pairs.options)
    first = lambda words: [kept for _, kept in pairs.followed(None, words)]
    found = search(n, lists, beam, first, options)
    return [{"score": value, "path": [{"segment": i, "word": number[i, id(words[0])]} for i, words in path]} for value, path in found]


_PATHS = "array<struct<score:int,path:array<struct<segment:int,word:int>>>>"


def solve(words: DataFrame, features: DataFrame, beam: int = BEAM, suffixes: DataFrame | None = None) -> DataFrame:
    """(run, segments, paths) of distinct runs.

    segments: by start and stop, each with its words, best first; paths: the best
    ``beam``, as segments and the word that each stands for.
    """
    word = F.struct((-F.col("score")).alias("minus"), "ordinal", "kind", "seq", "text", "kana", "score", "posi", "_a", "parts", "classes", "_types", "end_text")
    by_span = candidates(words, features, suffixes).groupBy("run", "start", "stop").agg(F.sort_array(F.collect_list(word)).alias("words"))
    segment = F.struct("start", "stop", "words")
    by_run = by_span.groupBy("run").agg(F.sort_array(F.collect_list(segment)).alias("segments"))
    whole = words.join(by_run, "run", "left")

    @F.pandas_udf(_PATHS)
    def paths(run: pd.Series, segments: pd.Series) -> pd.Series:
        return pd.Series([best_sequences(len(text), [] if found is None else found, beam) for text, found in zip(run, segments, strict=True)])

    return whole.withColumn("paths", paths("run", "segments"))


def tokens(texts: DataFrame, features: DataFrame, text_col: str = "text", method: str = DEFAULT, beam: int = BEAM, suffixes: DataFrame | None = None) -> DataFrame:
    """The best segmentation of every text: its columns, run_no, token_no, is_word, token, seq, kana, romaji, score.

    Text between words, also inside runs, is a token that is no word.
    """
    split = runs(texts, text_col)
    solved = solve(split.where("is_word").select("run").distinct(), features, beam, suffixes)

    @F.pandas_udf(StringType())
    def spell(kana: pd.Series) -> pd.Series:
        return kana.map(lambda k: None if k is None else romanize(k, method))

    picked = F.transform(F.col("paths")[0]["path"], lambda p: F.struct(F.get("segments", p["segment"]).alias("s"), p["word"].alias("w")))
    cut = lambda a, b: F.substring("run", a + 1, b - a)
    gap = lambda a, b: F.struct(F.lit(False).alias("is_word"), cut(a, b).alias("token"), F.lit(None).cast("int").alias("seq"), F.lit(None).cast("string").alias("kana"), F.lit(None).cast("int").alias("score"))

    def add(acc: Column, p: Column) -> Column:
        s = p["s"]
        best = F.get(s["words"], p["w"])
        here = F.struct(F.lit(True).alias("is_word"), best["text"].alias("token"), best["seq"].alias("seq"), best["kana"].alias("kana"), best["score"].alias("score"))
        before = F.when(s["start"] > acc["at"], F.array(gap(acc["at"], s["start"]))).otherwise(F.array().cast(_TOKENS))
        return F.struct(s["stop"].alias("at"), F.concat(acc["out"], before, F.array(here)).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(_TOKENS).alias("out"))
    n = F.char_length("run")
    listed = F.aggregate(picked, begin, add, lambda acc: F.when(acc["at"] < n, F.concat(acc["out"], F.array(gap(acc["at"], n)))).otherwise(acc["out"]))
    by_run = solved.select("run", listed.alias("_tokens"))
    other = F.array(F.struct(F.lit(False).alias("is_word"), F.col("run").alias("token"), F.lit(None).cast("int").alias("seq"), F.lit(None).cast("string").alias("kana"), F.lit(None).cast("int").alias("score")))
    joined = split.join(by_run, "run", "left").withColumn("_tokens", F.coalesce(F.when(F.col("is_word"), F.col("_tokens")), other))
    exploded = joined.select(*texts.columns, "run_no", F.posexplode("_tokens").alias("token_no", "_token")).select(*texts.columns, "run_no", "token_no", "_token.*")
    return exploded.withColumn("romaji", F.when(F.col("is_word"), spell("kana")).otherwise(F.col("token")))


_TOKENS = "array<struct<is_word:boolean,token:string,seq:int,kana:string,score:int>>"


def romanized(tokens_: DataFrame, *key: str) -> DataFrame:
    """One line of romaji for each key."""
    from ..functions.romaji import join_parts

    part = F.struct("run_no", "token_no", "romaji")
    return tokens_.groupBy(*key).agg(F.sort_array(F.collect_list(part)).alias("_parts")).select(*key, join_parts(F.transform("_parts", lambda p: p["romaji"])).alias("romaji"))
