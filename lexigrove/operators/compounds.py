"""Words made of others: roots with suffixes, contractions, numbers with counters.

A text is taken apart by relations, not by recursion: every cut of a text into a rest and
a suffix gives, by the arms of the suffix's rules, the text of the word that the rest stands for
(itself, or with its ending changed).  Such texts are cut again until nothing new comes.
Then words are made from the inside out: a join of cuts and words, repeated for as long as it
makes any.  Equal texts are taken apart once, wherever they stand.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as t
from ..functions import text as tx
from ..functions.counting import counter_reading
from ..sources.lexicon import Lexicon
from ..sources.tables import settled
from .lookups import Lookups


@dataclass(frozen=True)
class Arm:
    """One way to read a rest before a suffix of a kind.

    The word looked up is the rest without its last ``trim`` characters and with ``add``.  It
    must be of a conjugation type, or a part of speech, or a negative form, as far as named.
    Its reading loses ``stem`` kana and gets ``tail``; then come the connector and the suffix.
    The whole is worth ``constant`` more, or ``factor`` times the word's own worth and the
    length added.  A contraction (no entry of its own) takes the place of the word.
    """

    kind: str
    conj: tuple[int, ...] = ()
    pos: tuple[str, ...] = ()
    negative: bool = False
    roots: bool = False  # also words without a conjugation
    ends: tuple[str, ...] = ()  # the rest ends so
    not_ends: tuple[str, ...] = ()
    without: tuple[str, ...] = ()  # the rest is none of these
    only: tuple[str, ...] = ()
    heads: tuple[str, ...] = ()  # the suffix begins so
    trim: int = 0
    add: str = ""
    stem: int = 0
    tail: str = ""
    factor: int = 0
    constant: int = 0
    connector: str = ""
    after: tuple[str, ...] = ()  # the word's own last suffix is of one of these classes
    not_from: tuple[int, ...] = ()
    contraction: bool = False


_TE = ("て", "で")
_STEMS = (13, 51, 50)


def _looking(kind: str, factor: int, constant: int, only: tuple[str, ...] = (), without: tuple[str, ...] = ()) -> tuple[Arm, ...]:
    return (Arm(kind, conj=_STEMS, only=only, without=without, not_ends=("なさ",), factor=factor, constant=constant),)


def _fuller(kind: str, ending: str, stem: int) -> Arm:
    """A contraction of a longer ending, after any word."""
    return Arm(kind, roots=True, add=ending, stem=stem, contraction=True)


# The rules by kind of suffix.
_NO_SOU = ("な", "よ", "よさ", "に", "き")
ARMS: tuple[Arm, ...] = (
    Arm("tai", conj=(13,), without=("い",), factor=5),
    Arm("ren", conj=(13,), factor=5),
    Arm("ren-", conj=(13,)),
    Arm("neg", conj=(13, 52), factor=5),
    Arm("te", conj=(3,), ends=_TE, without=("で",)),
    Arm("teiru", conj=(3,), ends=_TE, without=("で", "いて"), factor=3),
    Arm("teiru+", conj=(3,), ends=_TE, without=("で", "いて"), factor=6),
    Arm("te+space", conj=(3,), ends=_TE, without=("で",), factor=3, connector=" "),
    Arm("kudasai", conj=(3,), ends=_TE, without=("で",), constant=360, connector=" "),
    Arm("teren", conj=(3,), ends=_TE, without=("で",), factor=4),
    Arm("teren", conj=(13,), not_ends=_TE, without=("い",), factor=4),
    Arm("teii", conj=(3,), ends=_TE, factor=1, connector=" "),
    Arm("chau", conj=(3,), heads=("ち",), add="て", stem=1, factor=5),
    Arm("chau", conj=(3,), heads=("じ",), add="で", stem=1, factor=5),
    Arm("to", conj=(3,), heads=("と",), add="て", stem=1),
    Arm("to", conj=(3,), heads=("ど",), add="で", stem=1),
    Arm("suru", pos=("vs",), factor=5, connector=" "),
    *_looking("sou", 0, 40, only=("から",)),
    *_looking("sou", 0, 0, only=("い",)),
    *_looking("sou", 0, 100, only=("出来",)),
    *_looking("sou", 0, 70, without=("から", "い", "出来", *_NO_SOU)),
    Arm("sou", negative=True, ends=("なさ",), trim=1, add="い", stem=1, tail="さ", constant=70),
    *_looking("sou+", 1, 0, without=_NO_SOU),
    Arm("sou+", negative=True, ends=("なさ",), trim=1, add="い", stem=1, tail="さ", factor=1),
    Arm("rou", conj=(2,), factor=1),
    Arm("adv", conj=(50,), factor=1),
    Arm("sugiru", pos=("adj-i",), without=("い",), not_ends=("なさ", "無さ"), add="い", stem=1, factor=5),
    Arm("sugiru", pos=("adj-i",), only=("なさ", "無さ"), trim=1, add="い", stem=1, tail="さ", factor=5),
    Arm("sugiru", negative=True, ends=("なさ", "無さ"), without=("なさ", "無さ"), trim=1, add="い", stem=1, tail="さ", factor=5),
    Arm("sa", conj=(51,), pos=("adj-na",), factor=2),
    Arm("iadj", conj=(51,), factor=1),
    Arm("garu", conj=(51,), without=("な", "い", "よ")),
    Arm("garu", roots=True, ends=("そ",), add="う", stem=1, after=("sou",)),
    Arm("ra", pos=("pn",), not_ends=("ら",), factor=1),
    Arm("rashii", conj=(2,), factor=3),
    Arm("desu", negative=True, ends=("ない", "なかった"), constant=200, connector=" "),
    Arm("desho", negative=True, ends=("ない",), constant=300, connector=" "),
    Arm("tosuru", conj=(9,), factor=3, connector=" "),
    Arm("kurai", conj=(2,), factor=3, connector=" "),
    # Contractions.
    Arm("nai", negative=True, roots=True, add="ない", stem=2, not_from=(1577980, 1547720), contraction=True),
    Arm("nai-x", negative=True, without=("せ",), add="ない", stem=2, not_from=(1157170,), contraction=True),
    Arm("nai-x", negative=True, only=("せ",), trim=1, add="しない", stem=3, tail="せ", contraction=True),
    Arm("nai-n", negative=True, add="ない", stem=2, not_from=(1577980, 1547720), contraction=True),
    _fuller("nakereba", "なければ", 4),
    _fuller("shimashou", "しましょう", 5),
    _fuller("dewanai", "ではない", 4),
    _fuller("teba", "てば", 2),
    _fuller("reba", "れば", 2),
    _fuller("keba", "けば", 2),
    _fuller("geba", "げば", 2),
    _fuller("neba", "ねば", 2),
    _fuller("beba", "べば", 2),
    _fuller("meba", "めば", 2),
    _fuller("seba", "せば", 2),
    _fuller("ii", "いい", 2),
)
#: Contractions as they are written, by kind.
CONTRACTIONS = (
    ("nai", "ねえ"), ("nai", "ねぇ"), ("nai", "ねー"), ("nai-x", "ず"), ("nai-x", "ざる"), ("nai-x", "ぬ"), ("nai-n", "ん"),
    ("nakereba", "なきゃ"), ("nakereba", "なくちゃ"), ("nakereba", "ねば"), ("teba", "ちゃ"), ("reba", "りゃ"), ("keba", "きゃ"),
    ("geba", "ぎゃ"), ("neba", "にゃ"), ("beba", "びゃ"), ("meba", "みゃ"), ("seba", "しゃ"), ("shimashou", "しましょ"),
    ("dewanai", "じゃない"), ("ii", "ええ"),
)
#: Suffixes as entries of the dictionary: (kind, entry, class).
SUFFIX_WORDS = (
    ("chau", 2013800, "chau"), ("chau", 2210750, "chau"), ("tai", 2017560, "tai"), ("ren-", 2772730, "nikui"), ("ren-", 2867504, "gatai"),
    ("te", 1577985, "oru"), ("te", 1296400, "aru"), ("te", 1547720, "kuru"), ("te", 1421850, "oku"), ("to", 2108590, "oku"), ("te", 1305380, "chau"),
    ("te+space", 1269130, "kureru"), ("te+space", 1535910, "morau"), ("te+space", 1587290, "itadaku"), ("suru", 1157170, "suru"),
    ("suru", 1421900, "itasu"), ("suru", 2269820, "sareru"), ("suru", 1005160, "saseru"), ("sou", 1006610, "sou"), ("sou+", 2141080, "sou+"),
    ("sugiru", 1195970, "sugiru"), ("ren", 2027910, "tsutsuaru"), ("adv", 1375610, "naru"), ("teren", 1012740, "yagaru"), ("rashii", 1013240, "rashii"),
    ("tosuru", 2136890, "tosuru"), ("garu", 1631750, "garu"),
)
#: Suffixes of one form: (kind, entry, form in the dictionary, text, class).
SUFFIX_FORMS = (
    ("chau", 2028920, "は", "ちゃ", "ha"), ("chau", 2028920, "は", "じゃ", "ha"), ("tai", 900000, "たそう", "たそう", "tasou"), ("teii", 2820690, "いい", "いい", "ii"),
    ("teii", 900001, "もいい", "もいい", "ii"), ("te", 2028940, "も", "も", "mo"), ("kudasai", 1184270, "ください", "ください", "kudasai"), ("rou", 1928670, "だろう", "ろう", "rou"),
    ("sa", 2029120, "さ", "さ", "sa"), ("ren", 1008120, "つつ", "つつ", "tsutsu"), ("ren", 1454500, "うる", "うる", "uru"), ("neg", 1529520, "なく", "なく", "nai"),
    ("ra", 2067770, "ら", "ら", "ra"), ("desu", 1628500, "です", "です", "desu"), ("desho", 1008420, "でしょう", "でしょう", "desho"), ("desho", 1008420, "でしょ", "でしょ", "desho"),
    ("kurai", 1154340, "くらい", "くらい", "kurai"), ("kurai", 1154340, "ぐらい", "ぐらい", "kurai"), ("ren", 2016470, "がち", "がち", "gachi"), ("iadj", 2006580, "げ", "げ", "iadj"),
    ("iadj", 1604890, "め", "め", "me"), ("ren-", 2606690, "がい", "がい", "gai"),
)
#: Classes that give no word where a plain word has the same text; desu and sa have conditions of their own.
ONLY_WITHOUT = ("ii", "seba", "meba", "beba", "neba", "geba", "keba", "reba", "teba", "eba", "dewanai", "nai-n", "gai", "nikui", "mo", "ra")
#: What suffixes mean, by class or by entry.
DESCRIPTIONS = {
    "chau": "indicates completion (to finish ...)", "ha": "topic marker particle", "tai": "want to... / would like to...",
    "iru": "indicates continuing action (to be ...ing)", "oru": "indicates continuing action (to be ...ing) (humble)",
    "aru": "indicates completion / finished action", "kuru": "indicates action that had been continuing up till now / came to be ",
    "oku": "to do in advance / to leave in the current state expecting a later change", "kureru": "(asking) to do something for one",
    "morau": "(asking) to get somebody to do something", "itadaku": "(asking) to get somebody to do something (polite)",
    "iku": "is becoming / action starting now and continuing", "suru": "makes a verb from a noun", "itasu": "makes a verb from a noun (humble)",
    "sareru": "makes a verb from a noun (honorific or passive)", "saseru": "let/make someone/something do ...",
    "rou": "probably / it seems that... / I guess ...", "ii": "it's ok if ... / is it ok if ...?", "mo": "even if ...", "sugiru": "to be too (much) ...",
    "nikui": "difficult to...", "gatai": "difficult to...", "sa": "-ness (degree or condition of adjective)", "tsutsu": "while ... / in the process of ...",
    "tsutsuaru": "to be doing ... / to be in the process of doing ...", "uru": "can ... / to be able to ...", "sou": "looking like ... / seeming ...",
    "nai": "negative suffix", "ra": "pluralizing suffix (not polite)", "kudasai": "please do ...", "yagaru": "indicates disdain or contempt",
    "naru": "to become ...", "desu": "formal copula", "desho": "it seems/perhaps/don't you think?", "tosuru": "to try to .../to be about to...",
    "garu": "to feel .../have a ... impression of someone", "me": "somewhat/-ish", "gai": "worth it to ...", "tasou": "seem to want to... (tai+sou)",
    2826528: "polite prefix", 2028980: "at / in / by", 2028970: "or / questioning particle", 2028990: "to / at / in", 2029010: "indicates direct object of action",
    1469800: "indicates possessive (...'s)", 2086960: "quoting particle", 1002980: "from / because",
}
IRU, IKU = 1577980, 1578850
DESU = 2755350
#: Characters of a number before a counter.
LONGEST_NUMBER = 20
#: Suffixes: text, kind of rule, class, entry and the form's ordinal; a contraction has no entry.
SUFFIXES = "suffix string, kind string, class string, suffix_seq int, suffix_ordinal long"


def suffix_forms(lexicon: Lexicon, words: list[tuple] = SUFFIX_WORDS, forms: list[tuple] = SUFFIX_FORMS, iru: int = IRU, iku: int = IKU, contractions=CONTRACTIONS) -> DataFrame:
    """All suffixes (SUFFIXES): forms of the ``words`` (kind, entry[, class]), single ``forms``, the verbs
    iru and iku, which may lose their first kana, and contractions."""
    spark = lexicon.entry.sparkSession
    keys = spark.createDataFrame([(w[0], w[1], w[2] if len(w) > 2 else w[0]) for w in words], "kind string, of int, class string")
    special = spark.createDataFrame([("iru", iru, "iru"), ("iku", iku, "iku")], "kind string, of int, class string")
    every = keys.unionByName(special)
    found = Lookups(lexicon).kana_forms(every.select(F.col("of").alias("seq")).distinct()).select("of", F.col("text").alias("suffix"), F.col("seq").alias("suffix_seq"), F.col("ordinal").alias("suffix_ordinal"))
    made = every.join(found, "of").drop("of")
    long = F.char_length("suffix") > 1
    short = F.expr("substring(suffix, 2)")
    of_iru, of_iku = made.where("kind = 'iru'"), made.where("kind = 'iku' AND suffix LIKE 'い%'")
    others = made.where("kind NOT IN ('iru', 'iku')").select("suffix", "kind", "class", "suffix_seq", "suffix_ordinal")
    rows = [
        others,
        of_iru.select("suffix", F.when(long, "teiru+").otherwise("teiru").alias("kind"), "class", "suffix_seq", "suffix_ordinal"),
        of_iru.where(long).select(short.alias("suffix"), F.lit("teiru").alias("kind"), "class", "suffix_seq", "suffix_ordinal"),
        of_iku.select("suffix", F.lit("te").alias("kind"), "class", "suffix_seq", "suffix_ordinal"),
        of_iku.where(long).select(short.alias("suffix"), F.lit("te").alias("kind"), "class", "suffix_seq", "suffix_ordinal"),
    ]
    single = spark.createDataFrame(forms or [], "kind string, seq int, text string, suffix string, class string") if forms else None
    if single is not None:
        rows.append(single.join(lexicon.kana_text.select("seq", "text", "ordinal"), ["seq", "text"]).select("suffix", "kind", "class", F.col("seq").alias("suffix_seq"), F.col("ordinal").alias("suffix_ordinal")))
    if contractions:
        rows.append(spark.createDataFrame([(text, kind, kind, None, None) for kind, text in contractions], SUFFIXES))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out.dropDuplicates(["suffix", "kind", "class", "suffix_seq"])


def description(seq: Column, suffixes: DataFrame) -> DataFrame:
    """(suffix_seq, description) of the suffixes that have one."""
    table = F.create_map(*[F.lit(str(x)) for pair in DESCRIPTIONS.items() for x in pair])
    by_class = suffixes.where("suffix_seq IS NOT NULL").select("suffix_seq", table[F.col("class")].alias("description")).distinct()
    return by_class.where("description IS NOT NULL").select(seq.alias("suffix_seq"), "description")


def apply_patch(text: Column, trim: Column, add: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), F.greatest(F.char_length(text) - trim, F.lit(0))), add)


_ARMS = (
    "kind string, arm int, conj array<int>, pos array<string>, negative boolean, roots boolean, ends array<string>, not_ends array<string>, without array<string>, only array<string>, "
    "heads array<string>, trim int, add string, stem int, tail string, factor int, constant int, connector string, after array<string>, not_from array<int>, contraction boolean"
)


def arms(spark) -> DataFrame:
    return spark.createDataFrame(
        [
            (a.kind, i, list(a.conj), list(a.pos), a.negative, a.roots, list(a.ends), list(a.not_ends), list(a.without), list(a.only), list(a.heads), a.trim, a.add, a.stem, a.tail, a.factor, a.constant, a.connector, list(a.after), list(a.not_from), a.contraction)
            for i, a in enumerate(ARMS)
        ],
        _ARMS,
    )


def _ends(text: Column, endings: Column) -> Column:
    return F.exists(endings, lambda e: F.endswith(text, e))


def cuts(texts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """texts (text) -> text, word (what is looked up), suffix, class, suffix_seq, and the arm's columns."""
    each = texts.where(F.char_length("text") > 1).select("text", F.explode(F.expr("sequence(1, char_length(text) - 1)")).alias("_at"))
    split = each.select("text", F.expr("substring(text, 1, _at)").alias("rest"), F.expr("substring(text, _at + 1)").alias("suffix"))
    known = split.join(suffixes, "suffix").join(F.broadcast(arms(texts.sparkSession)), "kind")  # the arms: a fixed list
    rest, empty = F.col("rest"), lambda c: F.size(c) == 0
    fits = (
        (empty("ends") | _ends(rest, F.col("ends")))
        & ~_ends(rest, F.col("not_ends"))
        & ~F.array_contains("without", rest)
        & (empty("only") | F.array_contains("only", rest))
        & (empty("heads") | F.array_contains("heads", F.left("suffix", F.lit(1))))
    )
    return known.where(fits).withColumn("word", apply_patch(rest, F.col("trim"), F.col("add")))


def taken_apart(texts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """cuts() of the texts, and of the words that they ask for, and so on until no new text is asked for.

    Every cut is shorter than its text by a suffix and longer by two kana at most, so this ends.
    """
    known = texts.select("text").distinct()
    out, fresh = None, known
    while True:
        made = settled(cuts(fresh, suffixes))
        out = made if out is None else out.unionByName(made)
        asked = made.select(F.col("word").alias("text")).distinct().join(known, "text", "left_anti")
        if asked.isEmpty():
            return out
        fresh = settled(asked)
        known = known.unionByName(fresh)


def chains(texts: DataFrame, features: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Words with suffixes and contractions among the texts.

    features: segment.word_features().  Returns its columns, of the first part, and whole,
    whole_kana, parts (entries), classes (of the suffixes), factor, constant, contraction and
    the last part's conj, posi and text.  A
    contraction of a plain word is a plain word: its only part is the word itself.
    """
    apart = taken_apart(texts, suffixes)
    wanted = apart.select(F.col("word").alias("text")).distinct()
    plain = features.join(wanted, "text", "left_semi")
    simple = plain.select(
        "*", F.col("text").alias("whole"), F.col("kana").alias("whole_kana"), F.array("seq").alias("parts"), F.array().cast("array<string>").alias("classes"),
        F.lit(0).alias("factor"), F.lit(0).alias("constant"), F.col("conj").alias("last_conj"), F.col("posi").alias("last_posi"), F.lit("").alias("last_text"), F.lit(False).alias("contraction"),
    )
    last = features.where("kind = 'kana'").select(F.col("seq").alias("suffix_seq"), F.col("ordinal").alias("suffix_ordinal"), F.col("conj").alias("_conj"), F.col("posi").alias("_posi"))
    edges = apart.select(
        F.col("text").alias("_text"), F.col("word").alias("whole"), "rest", "suffix", "class", "suffix_seq", "suffix_ordinal", F.col("conj").alias("_types"), F.col("pos").alias("_pos"),
        "negative", "roots", "stem", "tail", F.col("factor").alias("_factor"), F.col("constant").alias("_constant"), "connector", "after", "not_from", F.col("contraction").alias("_short"),
    ).join(last, ["suffix_seq", "suffix_ordinal"], "left")
    of_plain = _unique(features, edges)
    out, level = None, simple
    while True:
        made = settled(_longer(level, of_plain))
        if made.isEmpty():
            break
        out = made if out is None else out.unionByName(made)
        level = made
    return out if out is not None else _longer(simple, of_plain)


def _unique(features: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges but for those whose class gives no word where plain words have the text."""
    texts = features.select(F.col("text").alias("_text"), "root_p", F.exists("conj", lambda c: c["from"] == DESU).alias("_desu"))
    same = texts.groupBy("_text").agg(F.bool_or("root_p").alias("_root"), F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_desu")).alias("_of_desu"))
    cls = F.coalesce("class", F.lit(""))
    blocked = F.when(cls.isin(*ONLY_WITHOUT), F.col("_n") > 0).when(cls == "desu", F.col("_of_desu") < F.col("_n")).when(cls == "sa", F.col("_root")).otherwise(F.lit(False))
    return edges.join(same, "_text", "left").where(~F.coalesce(blocked, F.lit(False))).drop("_root", "_n", "_of_desu")


def _longer(words: DataFrame, edges: DataFrame) -> DataFrame:
    """Words one suffix longer than ``words``."""
    conj = F.col("last_conj")
    allowed_from = F.filter(conj, lambda c: ~F.array_contains("not_from", c["from"]))
    of_type = (F.size("_types") > 0) & F.exists(conj, lambda c: F.array_contains("_types", c["conj_type"]))
    of_pos = (F.size("_pos") > 0) & F.arrays_overlap("last_posi", "_pos")
    is_negative = F.col("negative") & (F.exists(allowed_from, lambda c: F.coalesce(c["neg"], F.lit(True))) | (F.col("roots") & (F.size(conj) == 0)))
    anything = F.col("roots") & ~F.col("negative")
    right_class = (F.size("after") == 0) | F.arrays_overlap("after", F.slice(F.reverse("classes"), 1, 1))
    met = words.join(edges, "whole").where((of_type | of_pos | is_negative | anything) & right_class)
    kana = F.concat(tx.destem_by(F.col("whole_kana"), F.col("stem")), "tail", "connector", "suffix")
    short = F.col("_short")
    plain_short = short & (F.size("parts") == 1)
    made = met.withColumns(
        {
            "text": F.when(plain_short, F.col("_text")).otherwise(F.col("text")),
            "kana": F.when(plain_short, kana).otherwise(F.col("kana")),
            "whole": F.col("_text"),
            "whole_kana": kana,
            "parts": F.when(short, F.col("parts")).otherwise(F.concat("parts", F.array("suffix_seq"))),
            "classes": F.when(short, F.col("classes")).otherwise(F.concat("classes", F.array("class"))),
            "factor": F.col("factor") + F.col("_factor"),
            "constant": F.col("constant") + F.col("_constant"),
            "last_conj": F.when(short, conj).otherwise(F.coalesce("_conj", F.array().cast(words.schema["conj"].dataType))),
            "last_posi": F.when(short, F.col("last_posi")).otherwise(F.coalesce("_posi", F.array().cast("array<string>"))),
            "last_text": F.when(short, F.col("last_text")).otherwise(F.col("suffix")),
            "contraction": short,
        }
    )
    return made.select(*words.columns).dropDuplicates(["whole", "whole_kana", "kind", "id", "parts", "factor", "constant"])


def with_counters(placed: DataFrame, spans: DataFrame) -> DataFrame:
    """Numerals before words that count (part of speech ctr): placed's columns with the text and
    reading of the whole, at the place of the whole."""
    numerals = spans.where(F.col("text").rlike(f"^{t.CHARACTER_CLASSES['number']}{{1,{LONGEST_NUMBER}}}$")).select(F.col("run").alias("_run"), F.col("start").alias("_start"), F.col("stop").alias("_mid"), F.col("text").alias("_number"))
    units = placed.where(F.array_contains("posi", "ctr"))
    met = units.join(numerals, (F.col("run") == F.col("_run")) & (F.col("start") == F.col("_mid")))
    reading = counter_reading(F.col("_number"), F.col("kana"), F.col("text"))
    return (
        met.withColumn("kana", reading)
        .where("kana IS NOT NULL")
        .withColumn("text", F.concat("_number", "text"))
        .withColumn("start", F.col("_start"))
        .withColumn("posi", F.array(F.lit("ctr")))
        .withColumn("conj", F.filter("conj", lambda c: F.lit(False)))
        .select(*placed.columns)
    )
