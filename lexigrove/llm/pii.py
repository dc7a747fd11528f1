"""Personal data by weak supervision: labelers vote, expectation-maximisation
weighs them, a span classifier decides.

Native: DataFrame functions only.  Candidate spans are the matches of the base
rules and of looser rules.  Seven labelers vote on each with 1, -1 or 0 (abstains):
the rule, the form of the value, a gazetteer, cue words before and after the span,
and its two edges.  They look at different things, and an abstention says nothing.
The votes are counted by pattern; a pattern is one of at most 9 rules x 3^7, so the table
of counts has a proven bound and expectation-maximisation runs on it.  Its posteriors
are the soft labels of a naive Bayes span classifier, whose features have a bounded
number of values.  Base spans always stay; loose candidates are added where the
classifier is sure (``sure``) and no base span overlaps them.
"""

from __future__ import annotations

import math
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_of, materialise, order_id, text_of

KINDS = ("email", "ip", "card", "phone")
#: Found as well, but by loose rules only, and reported apart.
SECRET = "secret"
#: The base rules.  Possessive forms and the condition on the start find the same
#: leftmost matches as the plain rules, in time linear in the text.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_HEX = r"[0-9A-Fa-f]{1,4}"
#: Looser rules: masked addresses, defanged and long IP addresses, numbers without a
#: country code or with other separators, quoted values that are assigned.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[\[({](?:at|AT)[\])}]\x20?|\x20AT\x20|\x20@\x20)[A-Za-z0-9-]++"
    r"(?:(?:\x20?[\[({](?:dot|DOT)[\])}]\x20?|\x20DOT\x20|\x20?\.(?=[A-Za-z0-9]))[A-Za-z0-9-]++)+",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\x20?[\[({](?:dot|DOT)[\])}]\x20?)[0-9]{1,3}){3}(?![0-9])|"
    rf"(?<![0-9A-Za-z:.]){_HEX}(?::{_HEX}){{7}}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9]{4}([./_])[0-9]{4}\3[0-9]{4}\3[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![0-9])|(?<![0-9+.-])00[1-9][0-9]{0,2}(?:[\x20.-][0-9]{2,4}){2,4}(?![0-9])",
    SECRET: r"(?<=[=:]\x20?[\"'])[A-Za-z0-9+/_.~-]{16,}+(?=[\"'])|(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+)",
}
#: What a text must hold for a rule to be tried.
_NEEDS = {
    ("email", True): r"@",
    ("ip", True): r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    ("card", True): r"[0-9](?:[\x20-]?[0-9]){12}",
    ("phone", True): r"\+[0-9]",
    ("email", False): r"[\[({](?:at|AT)[\])}]|\x20AT\x20|\x20@\x20",
    ("ip", False): rf"[0-9]\x20?[\[({{](?:\.|dot|DOT)|(?::{_HEX}){{7}}",
    ("card", False): r"[0-9]{4}[./_][0-9]{4}[./_]",
    ("phone", False): r"[0-9]{3}[.-][0-9]{4}|00[1-9][0-9]*+[\x20.-][0-9]",
    (SECRET, False): r"[=:]\x20?[\"'][A-Za-z0-9+/_.~-]{16}|AKIA|gh[pousr]_|xox",
}
# Gazetteers: public lists of endings, of calling codes (by zones) and of card issuers.
DOMAIN_ENDS = (
    "com", "org", "net", "edu", "gov", "mil", "int", "io", "co", "ai", "app", "dev", "info", "biz", "name", "me", "tv", "online", "site", "shop", "blog", "cloud",
    "at", "au", "be", "br", "ca", "ch", "cl", "cn", "cz", "de", "dk", "es", "eu", "fi", "fr", "gr", "hu", "ie", "il", "in", "it", "jp", "kr", "mx", "nl", "no",
    "nz", "pl", "pt", "ro", "ru", "se", "sg", "tr", "tw", "ua", "uk", "us", "za",
)
CALLING_CODES = (
    r"(?:00)?(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|35[0-9]|37[0-9]|38[0-9]|42[0-9]|50[0-9]|59[0-9]|67[0-9]|68[0-9]|69[0-2]|"
    r"80[08]|85[0-9]|87[08]|88[0-8]|96[0-9]|97[0-9]|99[2-8])[0-9]{6,}"
)
ISSUERS = (
    r"4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|(?:5[1-5][0-9]{2}|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[0-9]{12}|3[47][0-9]{13}|"
    r"3(?:0[0-5]|[68][0-9])[0-9]{11}|(?:6011|65[0-9]{2}|64[4-9][0-9])[0-9]{12}|35(?:2[89]|[3-8][0-9])[0-9]{12}|62[0-9]{14,17}|(?:50|5[6-9]|6[0-9])[0-9]{11,17}"
)
#: Addresses that belong to no one: this host, loopback, multicast and reserved.
NO_HOST = r"(?:0|127|22[4-9]|2[34][0-9]|25[0-5])\..*"
SECRET_SHAPES = r"[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|AKIA[0-9A-Z]{16}|gh[pousr]_.*|xox[abprs]-.*|(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_-]{20,}"
CUES = {
    "email": r"(?i)mail|contact|write|kontakt|correo|courriel|reach|schreib",
    "ip": r"(?i)\bip\b|host|server|address|adresse|client|login|connect",
    "card": r"(?i)card|visa|credit|karte|carte|tarjeta|payment|\bpay|charge",
    "phone": r"(?i)phone|\btel|call|\bfax|mobile|\bcell|anruf|llam|appel|ring me|dial",
    SECRET: r"(?i)token|secret|passw|pwd|key|credential|auth",
}
#: Words after or before a span that tell of something else.
DOUBTS = {
    "email": r"(?i)^\s*(?:\(\)|\{)",
    "ip": r"(?i)version|release|section|chapter|build",
    "card": r"(?i)order|serial|invoice|isbn|part|model|ticket|article",
    "phone": r"(?i)order|serial|invoice|isbn|part|model|ticket|article|page",
    SECRET: r"(?i)checksum|sha1|md5|commit|example|digest",
}
AFTER = {
    "email": r"(?i)^\W{0,3}(?:for|to|with|if|zu|pour|para|anytime)\b",
    "ip": r"(?i)^\W{0,3}(?:port|:[0-9]|/[0-9]|on|logged|connected)",
    "card": r"(?i)^\W{0,3}(?:exp|cvv|cvc|valid|until|[01]?[0-9]/[0-9]{2})",
    "phone": r"(?i)^\W{0,3}(?:ext|x[0-9]|or|for|between|after|anytime|mobile)\b",
    SECRET: r"^[\"']",
}
VOTES = ("v_rule", "v_form", "v_gazetteer", "v_before", "v_after", "v_left_edge", "v_right_edge")
FEATURES = ("f_kind", "f_length", "f_left", "f_right", "f_separators", "f_cue", "f_doubt", "f_known", "f_form")
CONTEXT = 32


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a non-empty string of digits passes the Luhn checksum."""

    def add(total: Column, i: Column) -> Column:
        x = F.substring(digits, -i, F.lit(1)).cast("int")
        doubled = F.when(x > 4, x * 2 - 9).otherwise(x * 2)
        return total + F.when(i % 2 == 0, doubled).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.char_length(digits), F.lit(1))), F.lit(0), add) % 10 == 0


def _small(part: Column) -> Column:
    plain = F.regexp_replace(part, "^0+", "")
    return (F.char_length(plain) < 4) & (F.coalesce(F.substring(plain, 1, 3).try_cast("int"), F.lit(0)) <= 255)


def _is_valid(kind: Column, span: Column) -> Column:
    """The conditions of the base rules; a long IP address has none."""
    digits = _digits(span)
    n = F.char_length(digits)
    return (
        F.when(kind == "ip", span.contains(":") | F.forall(F.split(F.regexp_replace(span, r"[^0-9]+", "."), r"\."), _small))
        .when(kind == "card", n.between(13, 19) & luhn(digits))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(F.lit(True))
    )


def _form(kind: Column, span: Column) -> Column:
    """1 or -1: whether the value is formed as such values are, beyond the rule itself."""
    digits = _digits(span)
    same = F.char_length(F.regexp_replace(digits, F.left(digits, F.lit(1)), "")) == 0
    name = F.substring_index(F.substring_index(F.regexp_replace(span, r"\x20?(?:[\[({](?:at|AT)[\])}]|AT|@)\x20?", "@"), "@", 1), " ", -1)
    good = (
        F.when(kind == "email", name.rlike(r"^[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?$") & ~span.contains(".."))
        .when(kind == "ip", span.contains(":") | ~span.rlike(r"(?:^|[^0-9])0[0-9]"))
        .when(kind.isin("card", "phone"), ~same)
        .otherwise(span.rlike("[0-9]") & span.rlike("[A-Za-z]"))
    )
    return F.when(good, 1).otherwise(-1)


def _known(kind: Column, span: Column) -> Column:
    """1, -1 or 0: what the gazetteers say."""
    digits = _digits(span)
    ending = F.lower(F.regexp_extract(span, r"([A-Za-z0-9-]+)$", 1))
    yes = lambda c: F.when(c, 1).otherwise(-1)
    return (
        F.when(kind == "email", yes(ending.isin(*DOMAIN_ENDS)))
        .when(kind == "ip", F.when(span.contains(":"), yes(span.rlike("^[23]"))).otherwise(yes(~F.regexp_replace(span, r"[^0-9]+", ".").rlike(f"^(?:{NO_HOST})$"))))
        .when(kind == "card", yes(digits.rlike(f"^(?:{ISSUERS})$")))
        .when(kind == "phone", F.when(span.rlike(r"^\+|^00"), yes(digits.rlike(f"^(?:{CALLING_CODES})$"))).otherwise(yes(digits.rlike("^[2-9][0-9]{2}[2-9]"))))
        .otherwise(yes(span.rlike(f"^(?:{SECRET_SHAPES})$")))
    )


def _by_kind(kind: Column, patterns: dict[str, str], text: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, text.rlike(p)) for k, p in patterns.items()])


def _found(kind: str, base: bool) -> Column:
    """The matches of one rule: array of (kind, base, at, skipped, span, left, head).

    ``left`` is what stands before the span, ``head`` what stands after the span before.
    """
    rule = (BASE if base else LOOSE)[kind]
    pattern = F.lit(f"(?s)(.*?)((?:{rule})|\\z)")  # the rule's own groups are numbered from 3
    gaps, spans = F.regexp_extract_all("_text", pattern, F.lit(1)), F.regexp_extract_all("_text", pattern, F.lit(2))
    row = lambda pair, i: F.struct(
        F.lit(kind).alias("kind"),
        F.lit(base).alias("base"),
        i.alias("at"),
        F.char_length(pair["gap"]).alias("skipped"),
        pair["span"].alias("span"),
        F.right(pair["gap"], F.lit(CONTEXT)).alias("left"),
        F.left(F.concat(F.left(pair["gap"], F.lit(CONTEXT)), pair["span"]), F.lit(CONTEXT)).alias("head"),
    )
    pairs = F.arrays_zip(gaps.alias("gap"), spans.alias("span"))
    needed = F.col("_text").rlike(_NEEDS[kind, base])
    return F.when(needed, F.transform(pairs, row)).otherwise(F.array().cast(_FOUND))


_FOUND = "array<struct<kind:string,base:boolean,at:int,skipped:int,span:string,left:string,head:string>>"


def candidates(rows: DataFrame) -> DataFrame:
    """(_id, _doc, kind, base, start, stop, valid, votes, features) of all candidate spans.

    ``rows`` has _id, _doc and _text; equal rows count once.
    """
    every = [_found(k, True) for k in BASE] + [_found(k, False) for k in LOOSE]
    begins = Window.partitionBy("_id", "_doc", "kind", "base").orderBy("at")
    spread = (
        rows.select("_id", "_doc", F.inline(F.concat(*every)))
        .repartition("_id", "_doc")
        .dropDuplicates(["_id", "_doc", "kind", "base", "at"])
        .withColumn("stop", F.sum(F.col("skipped") + F.char_length("span")).over(begins).cast("int"))
        .withColumn("right", F.coalesce(F.lead("head").over(begins), F.lit("")))
        .where("span <> ''")
        .withColumn("start", F.col("stop") - F.char_length("span"))
    )
    kind, span, left, right = F.col("kind"), F.col("span"), F.col("left"), F.col("right")
    edge = lambda c: (
        F.when(c == "", "none").when(c.rlike(r"\s"), "space").when(c.rlike(r"[\p{L}\p{N}]"), "word").when(c.rlike("[\"'=:(<>)\\[\\],;.!?]"), "mark").otherwise("other")
    )
    around = spread.withColumns(
        {
            "_valid": _is_valid(kind, span),
            "_form": _form(kind, span),
            "_known": _known(kind, span),
            "_cue": _by_kind(kind, CUES, left),
            "_doubt": _by_kind(kind, DOUBTS, left) | _by_kind(kind, DOUBTS, right),
            "_after": _by_kind(kind, AFTER, right),
            "_before_edge": edge(F.right(left, F.lit(1))),
            "_after_edge": edge(F.left(right, F.lit(1))),
        }
    )
    at_edge = lambda c: F.when(F.col(c) == "word", -1).when(F.col(c) == "mark", 1).otherwise(0)
    separators = F.least(F.char_length(F.regexp_replace(span, r"[^\x20().@_/:\[\]-]", "")), F.lit(4))
    return around.select(
        "_id", "_doc", "kind", "base", "start", "stop",
        F.col("_valid").alias("valid"),
        F.when(F.col("base") & F.col("_valid"), 1).when(~F.col("_valid"), -1).otherwise(0).alias("v_rule"),
        F.col("_form").alias("v_form"),
        F.col("_known").alias("v_gazetteer"),
        F.when(F.col("_doubt"), -1).when(F.col("_cue"), 1).otherwise(0).alias("v_before"),
        F.when(F.col("_after"), 1).otherwise(0).alias("v_after"),
        at_edge("_before_edge").alias("v_left_edge"),
        at_edge("_after_edge").alias("v_right_edge"),
        kind.alias("f_kind"),
        F.least(F.floor(F.char_length("span") / 4), F.lit(8)).cast("string").alias("f_length"),
        F.col("_before_edge").alias("f_left"),
        F.col("_after_edge").alias("f_right"),
        separators.cast("string").alias("f_separators"),
        F.col("_cue").cast("string").alias("f_cue"),
        F.col("_doubt").cast("string").alias("f_doubt"),
        F.col("_known").cast("string").alias("f_known"),
        F.col("_form").cast("string").alias("f_form"),
    )


def reliabilities(patterns: list[tuple], rounds: int = 30) -> tuple[dict[tuple, float], dict]:
    """Expectation-maximisation over vote patterns.

    patterns: (kind, votes, count), at most 9 x 3^7.  Returns the posterior that a
    span of the pattern is personal data, and for each labeler the probability of
    a yes where it votes, for what is personal data and for what is not.
    Labelers start as right in 4 of 5 votes; counts are smoothed by ten votes of that kind.
    """
    labelers = range(len(VOTES))
    kinds = {kind for kind, _, _ in patterns}
    prior = dict.fromkeys(kinds, 0.5)
    says_yes = [{True: 0.8, False: 0.2} for _ in labelers]
    posterior: dict[tuple, float] = {}
    for _ in range(rounds):
        for kind, votes, _n in patterns:
            odds = math.log(prior[kind] / (1 - prior[kind]))
            for k in labelers:
                if votes[k]:
                    yes, no = says_yes[k][True], says_yes[k][False]
                    odds += math.log(yes / no) if votes[k] > 0 else math.log((1 - yes) / (1 - no))
            posterior[kind, votes] = 1 / (1 + math.exp(min(700.0, max(-700.0, -odds))))
        for kind in kinds:
            own = [(posterior[k, v], n) for k, v, n in patterns if k == kind]
            prior[kind] = (sum(p * n for p, n in own) + 1) / (sum(n for _, n in own) + 2)
        for k in labelers:
            for truth, start in ((True, 8.0), (False, 2.0)):
                yes, total = start, 10.0
                for kind, votes, n in patterns:
                    if votes[k]:
                        mass = n * (posterior[kind, votes] if truth else 1 - posterior[kind, votes])
                        total += mass
                        yes += mass if votes[k] > 0 else 0.0
                says_yes[k][truth] = yes / total
    return posterior, {VOTES[k]: says_yes[k] for k in labelers}


def _lookup(entries: dict, key: Column, default: float) -> Column:
    if not entries:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(entries.items())])
    return F.coalesce(table[key], F.lit(default))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sure: float = 0.9) -> DataFrame:
    """One row per span: _id, _doc, kind (of KINDS or SECRET), start, stop, base, score."""
    rows = df.select(order_id(id_col).alias("_id"), text_of(text_col).alias("_text"))
    rows = rows.select("_id", F.xxhash64(F.lit(3), "_text").alias("_doc"), "_text")
    found = materialise(candidates(rows), "pii-candidates")
    family = F.concat_ws("/", "kind", F.col("base").cast("string"))  # loose spans have a prior of their own
    counted = found.groupBy(family.alias("kind"), *VOTES).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 9 x 3^7
    posterior, _ = reliabilities([(r["kind"], tuple(r[v] for v in VOTES), r["n"]) for r in counted])
    pattern = F.concat_ws(",", family, *VOTES)
    labels = {",".join([kind, *map(str, votes)]): p for (kind, votes), p in posterior.items()}
    labelled = found.withColumn("_soft", _lookup(labels, pattern, 0.5))
    value = lambda name: F.concat(F.lit(name + "="), F.coalesce(F.col(name), F.lit("")))
    sums = (
        labelled.select("_soft", F.explode(F.array(*map(value, FEATURES), F.lit("all"))).alias("value"))
        .groupBy("value")
        .agg(F.sum("_soft").alias("yes"), F.sum(1 - F.col("_soft")).alias("no"))
        .collect()  # as many rows as the features have values, under 70
    )
    mass = {r["value"]: (r["yes"], r["no"]) for r in sums}
    yes, no = mass.pop("all", (0.0, 0.0))
    weight = {v: math.log((a + 1) / (yes + 2)) - math.log((b + 1) / (no + 2)) for v, (a, b) in mass.items()}
    odds = F.lit(math.log((yes + 1) / (no + 1)))
    for name in FEATURES:
        odds = odds + _lookup(weight, value(name), 0.0)
    scored = labelled.withColumn("score", 1 / (1 + F.exp(-odds)))
    base = scored.where("base AND valid")
    loose = scored.where((~F.col("base")) & F.col("valid") & (F.col("score") >= sure))
    taken = base.select("_id", "_doc", F.col("start").alias("_from"), F.col("stop").alias("_to"))
    added = loose.join(
        taken,
        (loose["_id"] == taken["_id"]) & (loose["_doc"] == taken["_doc"]) & (loose["start"] < taken["_to"]) & (taken["_from"] < loose["stop"]),
        "left_anti",
    )
    return base.unionByName(added).select("_id", "_doc", "kind", "start", "stop", "base", "score")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sure: float = 0.9) -> DataFrame:
    """One row per input row: id, counts of base spans by kind, base_sha256, spans, n_spans, secrets.

    Spans are kind:start:end in code points, by kind as in KINDS, then start; secrets
    are start:end.  n_spans counts both.  Null or empty text has none; a null id
    stays null; repeated rows each give a row; other columns are ignored; an empty
    table gives an empty result.
    """
    rank = F.array_position(F.array(*map(F.lit, (*KINDS, SECRET))), F.col("kind"))
    entry = F.struct(
        rank.alias("rank"), F.col("start"), F.col("stop"), F.col("base"), F.col("kind"),
        F.concat_ws(":", "kind", "start", "stop").alias("name"),
    )
    by_row = (
        find(df, id_col, text_col, sure)
        .groupBy("_id", "_doc")
        .agg(
            F.sort_array(F.collect_list(entry)).alias("_all"),
            *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS],
        )
    )
    joined = lambda spans: F.coalesce(F.array_join(F.transform(spans, lambda s: s["name"]), ","), F.lit(""))
    return (
        df.select(order_id(id_col).alias("_id"), F.xxhash64(F.lit(3), text_of(text_col)).alias("_doc"))
        .join(by_row, ["_id", "_doc"], "left")
        .select(
            id_of(F.col("_id")).alias(id_col),
            *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
            F.sha2(joined(F.filter("_all", lambda s: s["base"])).cast("binary"), 256).alias("base_sha256"),
            joined(F.filter("_all", lambda s: s["kind"] != SECRET)).alias("spans"),
            F.coalesce(F.size("_all"), F.lit(0)).cast("long").alias("n_spans"),
            F.replace(joined(F.filter("_all", lambda s: s["kind"] == SECRET)), F.lit(SECRET + ":"), F.lit("")).alias("secrets"),
        )
    )
