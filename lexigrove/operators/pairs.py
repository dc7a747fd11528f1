"""Rules on adjacent words: bonuses and penalties, as a table.

A rule names what its left and right word must be and what the pair is worth.  The
rules of a lexicon refer to its entries by number; those below are fixed values
of the common public dictionary of Japanese.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

# Particles after nouns, by entry number.
NOUN_PARTICLES = (
    2028920, 2028930, 2028990, 2028980, 2029000, 1007340, 1579080, 1525680, 2028940, 1582300, 2215430, 1469800,
    1009990, 2029010, 1005120, 2034520, 1008490, 1008530, 1008590, 2028950, 2028960, 1009600,
)
NOUNS = frozenset({"n", "n-adv", "n-t", "adj-na", "n-suf", "pn"})
FINAL_PARTICLES = (2017770, 2425930, 2130430, 2029130, 2834812, 2718360, 2201380, 2722170, 2751630)
SEMI_FINAL_PARTICLES = (*FINAL_PARTICLES, 2029120, 2086640, 2029110, 2029080, 2029100)
NON_FINAL_PARTICLES = (2139720,)
#: Entries that are no words by themselves.
SKIPPED = (
    2013800, 2108590, 2029040, 2428180, 2654250, 2561100, 2210270, 2210710, 2257550, 2210320, 2017560, 2394890, 2194000, 2568000,
    2537250, 2760890, 2831062, 2831063, 2029030, 2568020, 2822120, 2827357,
)


@dataclass(frozen=True)
class Word:
    """What rules see of the best word of a span."""

    start: int
    stop: int
    text: str
    seqs: frozenset[int]
    pos: frozenset[str]
    solid: bool  # kanji or katakana
    primary: bool = False
    common: bool = False
    long: bool = False
    negative: bool = False
    parts: tuple[int, ...] = ()
    conj: frozenset[int] = frozenset()  # types of conjugation
    end_text: str = ""  # of a compound's last part
    score: int = 0


Test = Callable[[Word], bool]


def is_a(*seqs: int) -> Test:
    wanted = frozenset(seqs)
    return lambda w: bool(w.seqs & wanted)


def has_pos(*pos: str, sure: Callable[[Word], bool] = lambda w: w.solid or w.long or (w.primary and w.common)) -> Test:
    wanted = frozenset(pos)
    return lambda w: bool(w.pos & wanted) and sure(w)


def is_plain(*seqs: int) -> Test:
    """Of an entry, and no compound."""
    of = is_a(*seqs)
    return lambda w: len(w.parts) < 2 and of(w)


def is_conjugated(kind: int) -> Test:
    return lambda w: kind in w.conj


def ends_with(*seqs: int) -> Test:
    return lambda w: len(w.parts) > 1 and w.parts[-1] in seqs


def ends_in_text(*texts: str) -> Test:
    return lambda w: len(w.parts) > 1 and w.end_text in texts


def begins(kana: str) -> Test:
    return lambda w: w.text.startswith(kana)


def none_of(test: Test) -> Test:
    return lambda w: not test(w)


def short(*without: str) -> Test:
    return lambda w: w.stop - w.start <= 1 and not w.solid and w.text not in without


noun = has_pos(*NOUNS)


@dataclass(frozen=True)
class Rule:
    name: str
    left: Test
    right: Test
    worth: Callable[[Word, Word], int]
    abut: bool = True
    any_word: bool = False  # of a penalty: any word of a list, else its best

    def test(self, of: Test, words: tuple[Word, ...]) -> bool:
        return any(map(of, words)) if self.any_word else of(words[0])


def worth(n: int) -> Callable[[Word, Word], int]:
    return lambda left, right: n


# Fixed values.
BONUSES = (
    Rule("counter + every", has_pos("ctr", sure=lambda w: True), is_a(2854117, 2084550), worth(20)),
    Rule("as is", is_a(1469800), is_a(1432920), worth(50)),
    Rule("only + negative", is_a(1005460), lambda w: w.negative, worth(50)),
    Rule("must not", ends_with(2028920), is_a(1000730, 1612750, 1409110, 2829697, 1587610), worth(50)),
    Rule("kanji prefix + noun", is_a(2242840, 1922780, 2423740), has_pos("n", sure=lambda w: w.solid), worth(15)),
    Rule("honorific + noun", is_a(1270190), has_pos("n", sure=lambda w: w.solid or w.long), worth(10)),
    Rule("noun + -ness", noun, is_a(1375260), worth(12)),
    Rule("noun + after", noun, is_a(1361140), worth(40)),
    Rule("noun + plural", noun, is_a(1416220), worth(10)),
    Rule("noun + during", noun, is_a(1620400, 2083570), worth(12)),
    Rule("adverb + to", has_pos("adv-to", sure=lambda w: w.solid or w.long or w.primary), is_a(1008490), lambda a, b: 10 + 10 * (a.stop - a.start)),
    Rule("na-adjective", has_pos("adj-na"), is_a(2029110, 2028990), worth(15)),
    Rule("no-adjective", has_pos("adj-no"), is_a(1469800), worth(15)),
    Rule("that is so", is_a(2137720), is_a(2140410), worth(50)),
    Rule("no + copula", is_a(1469800, 2139720), is_a(2089020, 1007370, 1928670), worth(15)),
    Rule("noun + copula", noun, is_a(2089020), worth(10)),
    Rule("noun + particle", noun, is_a(*NOUN_PARTICLES), lambda a, b: 10 + 4 * (b.stop - b.start)),
)
PENALTIES = (
    Rule("semi-final particle inside", is_a(*SEMI_FINAL_PARTICLES), lambda w: True, worth(-15), any_word=True),
    Rule("short after short", short(), short("と"), worth(-9), abut=False),
)


@dataclass(frozen=True)
class Follow:
    """Words that ``right`` tells stand only after adjacent words that ``left`` tells; at the
    beginning too with ``first``."""

    name: str
    left: Test
    right: Test
    first: bool = True


# What must follow what, in the order that they apply.
FOLLOWS = (
    Follow("auxiliary after a stem", is_conjugated(13), is_a(1342560), first=False),
    Follow("iru not after tsu", none_of(is_a(2221640)), is_a(1577980)),
    Follow("n not after a noun particle", none_of(is_plain(*NOUN_PARTICLES)), is_a(2139720, 2849370, 2849387)),
    Follow("karasu after wo", is_a(2029010), is_a(2087020), first=False),
    Follow("no compound that ends so", lambda w: False, ends_in_text("ちゃい", "いか", "とか", "とき", "い"), first=False),
    Follow("no literary liking", lambda w: False, lambda w: 54 in w.conj and w.text.endswith("好き"), first=False),
    Follow("ku not after -iro", none_of(ends_in_text("いろ")), begins("く")),
    Follow("e not after sa", none_of(ends_with(2029120)), begins("え")),
    Follow("nai not after a compound with wa", none_of(ends_with(2028920)), is_a(1529520, 1296400, 2139720)),
    Follow("hayameru not after no", none_of(is_a(1469800)), is_a(1601080)),
    Follow("omou, iu not after nandato", none_of(is_a(2837117)), is_a(1589350, 1587040)),
    Follow("totte not after to", none_of(is_a(1008490)), is_a(2086960)),
    Follow("suru not after da", lambda w: 2089020 not in w.seqs or 2028980 in w.seqs, is_a(1157170, 2424740, 1305070)),
    Follow("kuru not after de", none_of(is_a(1896380, 2422860)), is_a(2830009, 1547720)),
    Follow("honorific not after a noun particle", none_of(is_a(*NOUN_PARTICLES)), is_a(1247260), first=False),
    Follow("ni not after mo", none_of(is_a(2028940)), is_a(1009980)),
)

Words = tuple[Word, ...]


def followed(left: Words | None, right: Words, rules: tuple[Follow, ...] = FOLLOWS) -> list[tuple[Words | None, Words]]:
    """The pairs of lists that stay of two neighbours (``left`` None: nothing before).  A list
    may be split: words that need certain words before them go with those."""
    pairs = [(left, right)]
    for rule in rules:
        pairs = [kept for pair in pairs for kept in _one_rule(rule, *pair)]
    return pairs


def _one_rule(rule: Follow, left: Words | None, right: Words) -> list[tuple[Words | None, Words]]:
    bound = tuple(filter(rule.right, right))
    if not bound or (left is None and rule.first):
        return [(left, right)]
    free = tuple(w for w in right if w not in bound)
    unbound = [(left, free)] if free else []
    if left is None or left[0].stop != right[0].start:
        return unbound
    good = tuple(filter(rule.left, left))
    if len(good) == len(left):
        return [(left, right)]
    return ([(good, bound)] if good else []) + unbound


def options(left: Words, right: Words) -> list[tuple[Words, Words, int]]:
    """What two neighbouring lists may become, and what each counts: as they are, with the first
    penalty that applies, or as the words that a bonus is for."""
    out = []
    for a, b in followed(left, right):
        applies = lambda r, a=a, b=b: (not r.abut or a[0].stop == b[0].start) and r.test(r.left, a) and r.test(r.right, b)
        out.append((a, b, next((r.worth(a[0], b[0]) for r in PENALTIES if applies(r)), 0)))
        if a[0].stop == b[0].start:
            for r in BONUSES:
                x, y = tuple(filter(r.left, a)), tuple(filter(r.right, b))
                if x and y:
                    out.append((x, y, r.worth(x[0], y[0])))
    return out


def value(left: Word, right: Word, bonuses: tuple[Rule, ...] = BONUSES, penalties: tuple[Rule, ...] = PENALTIES) -> int:
    """The best of what a pair may count: each bonus by itself, or the first penalty that applies, else 0."""
    fires = lambda r: (not r.abut or left.stop == right.start) and r.left(left) and r.right(right)
    plain = next((r.worth(left, right) for r in penalties if fires(r)), 0)
    return max([plain, *(r.worth(left, right) for r in bonuses if fires(r))])
