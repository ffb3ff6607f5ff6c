"""Text functions as native columns: Column in, Column out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.lexicon import CASED, DATED, FOLDED, LISTED, PAIR_STARTS, PAIRED, QUICK, UNDATED, by_initials, guarded, jvm, needed_words, phrases, several_words, single_words, word_pairs

_SPACE = r"[\s\x1c-\x1f]"
PLACE = "struct<s:int,e:int,m:string>"
_GROUP, _PIECE = 64, 1024
_MARK = "\x01"
#: Matches of a text up to which windows are made from the text between marks.
_FEW = 16
#: The characters of _SPACE, for a strip that looks at the ends of a text only.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


#: One of these is in each match of the pattern of quotes.
QUOTES = ('"', "\u201c", "\u201d")


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


#: White space of ASCII texts but blanks and new lines.
_RARE_SPACES = tuple(map(chr, (0x09, *range(0x0B, 0x0E), *range(0x1C, 0x20))))


def tidy(text: Column, ascii: Column | None = None) -> Column:
    """Whether an ASCII text has no white space but blanks and new lines; looked for one by one, which costs less than a pattern. ascii: is_ascii() of the text, where it is at hand."""
    return _ascii(text, ascii) & ~any_of(text, _RARE_SPACES)


def normalize(text: Column, neat: Column | None = None) -> Column:
    """Runs of white space become one blank; none is left at the ends. neat: tidy() of the text, where it is at hand, here and below."""
    if neat is None:
        return bound(text, lambda t: normalize(t, tidy(t)))
    blanks = F.replace(text, F.lit("\n"), F.lit(" "))
    # of an ASCII text, blanks that stand alone stay as they are
    plain = F.regexp_replace(text, r"[\t-\r\x1c-\x1f][\t-\r\x1c- ]*| [\t-\r\x1c- ]+", " ")
    return F.trim(F.when(neat & ~F.contains(blanks, F.lit("  ")), blanks).when(is_ascii(text), plain).otherwise(F.regexp_replace(text, jvm(f"{_SPACE}+"), " ")))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), 0)


def n_words(text: Column) -> Column:
    """Words between white space."""
    some = lambda words: F.size(F.filter(words, lambda w: w != ""))
    return bound(text, lambda t: F.when(tidy(t), some(F.split(F.replace(t, F.lit("\n"), F.lit(" ")), " "))).otherwise(some(F.split(strip(t), jvm(f"{_SPACE}+")))))


def sentences(text: Column, neat: Column | None = None) -> Column:
    parts = F.split(strip(text), jvm(r"(?<=[.!?])\s+|\n+"), -1)
    cut = text
    for end in ".!?":  # blanks that are left over are trimmed off
        cut = F.replace(cut, F.lit(f"{end} "), F.lit(f"{end}\n"))
    plain = F.transform(F.split(cut, "\n", -1), lambda s: F.trim(s))
    return F.filter(F.when(tidy(text) if neat is None else neat, plain).otherwise(F.transform(parts, strip)), lambda s: s != "")


def pattern(name: str) -> str:
    fold = name in FOLDED
    return jvm(guarded(FOLDED[name] if fold else CASED[name], fold), fold=fold)


def ascii_pattern(name: str) -> str:
    """The same for ASCII texts: there Java's own classes, boundaries and folding are those of Unicode, and faster."""
    if name in QUICK:
        return "(?i)" * (name in FOLDED) + QUICK[name]
    return "(?i)" + by_initials(FOLDED[name]) if name in FOLDED else guarded(CASED[name], False)


def _ascii(text: Column, known: Column | None) -> Column:
    return is_ascii(text) if known is None else known


def count(text: Column, name: str, ascii: Column | None = None, low: Column | None = None) -> Column:
    """Number of non-overlapping matches of a named pattern. ascii: is_ascii() of the text, low: the text in lower case, where they are at hand, here and below."""
    quick = F.regexp_count(text, F.lit(ascii_pattern(name)))
    if low is not None and name in FOLDED:
        quick = F.regexp_count(low, F.lit(by_initials(FOLDED[name])))
    if name in UNDATED:
        quick = F.when(text.rlike(DATED), quick).otherwise(F.regexp_count(text, F.lit(UNDATED[name])))
    return F.when(_ascii(text, ascii), quick).otherwise(F.regexp_count(text, F.lit(pattern(name))))


def has(text: Column, name: str, ascii: Column | None = None) -> Column:
    quick = text.rlike(ascii_pattern(name))
    if name in UNDATED:
        quick = text.rlike(UNDATED[name]) | (text.rlike(DATED) & quick)
    return F.when(_ascii(text, ascii), quick).otherwise(text.rlike(pattern(name)))


#: Characters beyond ASCII that match ASCII letters where case is ignored.
_FOLDS = ("ſ", "ı", "İ", "\u212a")


def plain_words(text: Column, ascii: Column | None = None) -> Column:
    """All words of a plain text in lower case, in order; null for texts that aren't plain.

    A plain text is ASCII without underscores: its words are runs of letters and digits, and nothing else stands for such.
    """
    plain = _ascii(text, ascii) & ~F.contains(text, F.lit("_"))
    return F.when(plain, F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), ""))


def listed(text: Column, words: Column | None = None) -> Column:
    """The words of a plain text that are in word lists, as often as they occur; null for texts that aren't plain. words: its plain_words(), where they are at hand."""
    return F.filter(plain_words(text) if words is None else words, lambda w: w.isin(*LISTED))


def vocabulary(text: Column, known: Column | None = None) -> Column:
    """The ASCII words of a text in lower case, each once; null where other characters may stand for letters.

    known: listed() of the text, where it is at hand; of a plain text they are all that is looked for, and stay as they are.
    """
    words = F.when(~any_of(text, _FOLDS), F.array_distinct(F.split(F.lower(text), "[^a-z0-9]+")))
    return words if known is None else F.coalesce(known, words)


def paired(words: Column) -> Column:
    """The pairs of neighbouring words, with a blank between them, by which terms of several words of lists are found. words: plain_words()."""
    pairs = F.transform(words, lambda w, i: F.when(w.isin(*PAIR_STARTS), F.concat(w, F.lit(" "), F.get(words, i + 1))))
    return F.filter(pairs, lambda p: p.isin(*PAIRED))


def any_in(vocabulary: Column, words: tuple[str, ...]) -> Column:
    return F.exists(vocabulary, lambda w: w.isin(*words)) if words else F.lit(False)


def may_occur(vocabulary: Column, name: str) -> Column:
    """False only where no match of a named pattern can be: none of the words that one must have is there.

    One look into the words that a text has, in place of a pass of the pattern over the text.
    """
    words = needed_words(FOLDED[name] if name in FOLDED else CASED[name])
    return F.lit(True) if words is None else vocabulary.isNull() | any_in(vocabulary, words)


def joined(words: Column) -> Column:
    """Words with a blank around each, in which terms of several words are looked for."""
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def by_words(vocabulary: Column, known: Column, name: str, matched: Column, line: Column | None = None, pairs: Column | None = None, low: Column | None = None) -> Column:
    """matched, the number of matches of a named list, from the listed words alone where no term of several words can be.

    line: joined() plain_words(), or pairs: paired() plain_words(), and low: the text in lower case, where they are at hand; with
    both, terms of one word are counted from the listed words also where others can be, if the two can be told apart.
    """
    own = single_words(FOLDED[name]) if name in FOLDED else None
    gated = F.when(may_occur(vocabulary, name), matched).otherwise(0)
    if own is None or not own[0] and pairs is None:
        return gated
    single, others = own
    several = any_in(vocabulary, others) if line is None else any_in(vocabulary, others) & any_of(line, phrases(FOLDED[name]))
    if pairs is not None:
        near, lone = word_pairs(FOLDED[name])
        several = any_in(pairs, near) | any_in(vocabulary, lone)
    alone = F.size(F.filter(known, lambda w: w.isin(*single))) if single else F.lit(0)
    rest = several_words(FOLDED[name])
    if pairs is not None and low is not None and rest:
        return F.when(known.isNotNull(), alone + F.when(several, F.regexp_count(low, F.lit(rest))).otherwise(0)).otherwise(gated)
    return F.when(known.isNotNull() & ~several, alone).otherwise(gated if pairs is None else F.when(known.isNotNull(), matched).otherwise(gated))


def count_in(text: Column, vocabulary: Column, name: str, known: Column | None = None, ascii: Column | None = None, line: Column | None = None, pairs: Column | None = None, low: Column | None = None) -> Column:
    """count(), of a text with this vocabulary, and these words of lists."""
    matched = count(text, name, ascii, low)
    return F.when(may_occur(vocabulary, name), matched).otherwise(0) if known is None else by_words(vocabulary, known, name, matched, line, pairs, low)


def any_of(text: Column, parts: tuple[str, ...]) -> Column:
    """Whether one of the strings occurs, anywhere in a word."""
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(text, F.lit(part))
    return found


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def py_round(x: Column, digits: int) -> Column:
    """Rounding of the exact binary value, ties to even, for moderate numbers.

    x * 10**digits is held as an exact sum of two doubles, so the comparison with one half is exact.
    """
    scale = float(10**digits)
    high = x * 134217729.0 - (x * 134217729.0 - x)
    low = x - high
    whole = F.floor(x * scale)
    over = ((high * scale - whole) - 0.5) + low * scale
    up = F.when((over > 0) | ((over == 0) & (whole % 2 != 0)), 1).otherwise(0)
    return F.when(x.isNotNull(), (whole + up) / scale)


def netloc(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, where it would be computed again for each element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scan(items: Column, start: Column, state: str, out: str, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column]) -> Column:
    """emit(state before, x) of each element, with step(state before, x) as the next state; state and out are their types.

    An array is copied whenever it grows, so results are gathered in groups of 64 and these put together.
    """

    def group(before: Column, some: Column) -> Column:
        return F.aggregate(some, F.struct(before.alias("state"), F.array().cast(f"array<{out}>").alias("out")), lambda a, x: F.struct(step(a["state"], x).cast(state).alias("state"), F.concat(a["out"], F.array(emit(a["state"], x).cast(out))).alias("out")))

    def whole(l: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(l) - 1) / _GROUP).cast("int"), F.lit(0))), lambda c: F.slice(l, c * _GROUP + 1, F.lit(_GROUP)))
        first = F.struct(start.cast(state).alias("state"), F.array().cast(f"array<array<{out}>>").alias("out"))
        return F.aggregate(groups, first, lambda acc, some: bound(group(acc["state"], some), lambda g: F.struct(g["state"].alias("state"), F.concat(acc["out"], F.array(g["out"])).alias("out"))), lambda acc: F.flatten(acc["out"]))

    return bound(items, whole)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of a pattern that never matches nothing: struct(s, e, m), places in code points, ends exclusive.

    Marks are put around the matches, in one pass; what lies between marks is by turns a gap and a match, whose lengths
    give the places. A text with such a mark of its own takes two passes.
    """
    pair = lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m"))
    laid = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0), pair)
    own = F.filter(laid, lambda x: x["m"].isNotNull())
    parts = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
    turns = lambda p: F.when(F.size(p) > 1, F.sequence(F.lit(0), F.size(p) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    marked = bound(parts, lambda p: F.transform(turns(p), lambda i: pair(p[i], p[i + 1])))
    kept = F.when(F.contains(text, F.lit(_MARK)), own).otherwise(marked)
    end = lambda at, x: at + x["g"] + F.length(x["m"])
    return scan(kept, F.lit(0), "int", PLACE, end, lambda at, x: F.struct((at + x["g"]).alias("s"), end(at, x).alias("e"), x["m"].alias("m")))


def places(text: Column, name: str) -> Column:
    """Matches of a named pattern with their start and end (code points), in order."""
    return F.when(is_ascii(text), matches(text, ascii_pattern(name))).otherwise(matches(text, pattern(name)))


def pieces(text: Column) -> Column:
    """The text cut into equal pieces, for piece(); any part of a long text is then at hand without counting from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), 0)


def piece(cut: Column, start: Column, n: Column) -> Column:
    """n characters of pieces() from start (0 is the first)."""
    first = F.floor(start / _PIECE).cast("int")
    some = F.slice(cut, first + 1, F.floor((start + n) / _PIECE).cast("int") - first + 1)
    return F.substring(F.array_join(some, ""), start - first * _PIECE + 1, n)


def around(cut: Column, place: Column, k: int) -> Column:
    """The match with up to k characters on either side; cut: pieces() of the text."""
    low = F.greatest(place["s"] - k, F.lit(0))
    return piece(cut, low, place["e"] + k - low)


def marked(text: Column, name: str, ascii: Column | None = None) -> Column:
    """The parts of a text between marks around the matches of a named pattern: by turns a gap and a match."""
    mark = lambda pattern: F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
    return F.when(_ascii(text, ascii), mark(ascii_pattern(name))).otherwise(mark(pattern(name)))


def holds_mark(text: Column) -> Column:
    """Whether a text has a mark of its own, so that marked() would not tell its matches."""
    return F.contains(text, F.lit(_MARK))


def n_marked(parts: Column) -> Column:
    """The number of matches in marked()."""
    return F.floor((F.size(parts) - 1) / 2).cast("int")


def windows(text: Column, name: str, k: int, most: int | None = None, ascii: Column | None = None, parts: Column | None = None) -> Column:
    """The first matches of a named pattern, all if most is None, each with up to k characters on either side. parts: marked(), where it is at hand.

    With few matches, what stands before and behind each is put together from the parts between marks; more of them
    are cut out by their places, in proportion to the text.
    """
    of = lambda found: found if most is None else F.slice(found, 1, most)
    by_places = bound(pieces(text), lambda cut: F.transform(of(places(text, name)), lambda p: around(cut, p, k)))
    # mostly the next gap is long enough
    before = lambda p, i: F.substring(F.when(F.length(F.get(p, i - 1)) >= k, F.get(p, i - 1)).otherwise(F.array_join(F.slice(p, F.lit(1), i), "")), -k, k)
    behind = lambda p, i: F.substring(F.when(F.length(F.get(p, i + 1)) >= k, F.get(p, i + 1)).otherwise(F.array_join(F.slice(p, i + 2, F.size(p)), "")), 1, k)
    by_marks = lambda p: F.transform(of(F.sequence(F.lit(1), F.size(p) - 2, F.lit(2))), lambda i: F.concat(before(p, i), F.get(p, i), behind(p, i)))
    few = lambda p: F.when(F.size(p) < 3, F.array().cast("array<string>")).when(F.size(p) <= 2 * _FEW + 1, by_marks(p)).otherwise(by_places)
    return F.when(F.contains(text, F.lit(_MARK)), by_places).otherwise(bound(marked(text, name, ascii), few) if parts is None else few(parts))


def snippets(text: Column, name: str, most: int | None, k: int = 60, ascii: Column | None = None, parts: Column | None = None, n: Column | None = None) -> Column:
    """Surroundings of the first matches, of all if most is None. n: count(), parts: marked(), where they are at hand; a text without a match is not looked at again."""
    made = F.transform(windows(text, name, k, most, ascii, parts), lambda w: normalize(w))
    return made if n is None else F.when(n > 0, made).otherwise(F.array().cast("array<string>"))


def compress(text: Column, most: int = 200) -> Column:
    """At most ``most`` characters, cut at a blank in the second half if there is one, with an ellipsis."""
    text = strip(text)
    head = F.substring(text, 1, most)
    blank = F.when(F.instr(head, " ") > 0, F.lit(most) - F.instr(F.reverse(head), " ")).otherwise(F.lit(-1))
    cut = F.when(blank > most // 2, F.substring(head, F.lit(1), blank)).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(cut, jvm(r"[\s.,;:\-–—(\[{]+$"), ""), F.lit("…")))


def unique_folded(items: Column) -> Column:
    """Distinct whatever the case, in order, in the form seen first."""
    start = F.array().cast("array<string>")
    return F.aggregate(items, start, lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))


def all_of(text: Column, name: str, ascii: Column | None = None) -> Column:
    """All matches of a named pattern."""
    return F.when(_ascii(text, ascii), F.regexp_extract_all(text, F.lit(ascii_pattern(name)), 0)).otherwise(F.regexp_extract_all(text, F.lit(pattern(name)), 0))


def found(text: Column, name: str, vocabulary: Column | None = None, ascii: Column | None = None) -> Column:
    hits = all_of(text, name, ascii)
    hits = hits if vocabulary is None else F.when(may_occur(vocabulary, name), hits).otherwise(F.array().cast("array<string>"))
    return unique_folded(hits)


def looks_non_english(text: Column, ascii: Column | None = None) -> Column:
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    ascii_letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    english = has(text, "logic") | has(text, "hedges") | has(text, "certainty")
    other = (letters >= 20) & (ascii_letters / F.greatest(letters, F.lit(1)) < 0.70) & ~english
    return F.when(_ascii(text, ascii), False).when(text.isNotNull(), other)


def exclaims(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))


def shouting(text: Column, ascii: Column | None = None) -> Column:
    """Share of words of four or more ASCII letters in capitals, above a fifth; 0 below eight words or four of them."""

    def share(long: Column, caps: Column) -> Column:
        ratio = caps / F.greatest(long, F.lit(1))
        return F.when((long < 8) | (caps < 4) | (ratio < 0.20), F.lit(0.0)).otherwise(clamp((ratio - 0.20) * 5.0))

    words = F.regexp_extract_all(text, F.lit(pattern("caps_word")), 0)
    loud = F.regexp_count(text, F.lit(r"(?=[A-Z]{4})\b[A-Z]{4,}+\b"))  # of ASCII texts; few have four
    counted = F.struct(F.regexp_count(text, F.lit(ascii_pattern("caps_word"))).alias("long"), loud.alias("caps"))
    plain = F.when(loud < 4, F.lit(0.0)).otherwise(bound(counted, lambda c: share(c["long"], c["caps"])))
    return F.when(_ascii(text, ascii), plain).otherwise(share(F.size(words), F.size(F.filter(words, lambda w: w == F.upper(w)))))


def attribution(text: Column, quotes: Column | None = None, ascii: Column | None = None) -> Column:
    """Share of long quotes with a name and a verb of saying within 120 characters; 0 without quotes. quotes: their number, where it is at hand."""
    near = windows(text, "quote", 120, ascii=ascii)
    named = F.transform(near, lambda t: (has(t, "attribution_verb") & has(t, "name")).cast("int"))
    counted = F.aggregate(named, F.struct(F.lit(0).alias("n"), F.lit(0).alias("all")), lambda a, x: F.struct((a["n"] + x).alias("n"), (a["all"] + 1).alias("all")))
    share = bound(counted, lambda c: F.when(c["all"] == 0, F.lit(0.0)).otherwise(clamp(c["n"] / F.greatest(c["all"], F.lit(1)))))
    return share if quotes is None else F.when(quotes == 0, F.lit(0.0)).otherwise(share)


def coherence(tokens: Column, sents: Column, low: Column | None = None, vocabulary: Column | None = None, known: Column | None = None, ascii: Column | None = None, pairs: Column | None = None, single: Column | None = None) -> Column:
    """Connectives a sentence, variety of words and of sentence lengths; unrounded; 0.5 below ten words.

    low: the tokens in lower case, vocabulary, known, ascii and pairs: those of the text, where they are at hand; single: whether it has blanks only within its sentences, and none beside another.
    """
    low = F.transform(tokens, F.lower) if low is None else low
    line = F.array_join(low, " ")
    hits = count(line, "connectives", ascii, line)
    if vocabulary is not None:
        hits = F.when(may_occur(vocabulary, "connectives"), hits).otherwise(0) if known is None else by_words(vocabulary, known, "connectives", hits, pairs=pairs, low=line)
    connected = F.least(hits / F.greatest(F.size(sents), F.lit(1)) / 0.25, F.lit(1.0))
    variety = F.least(F.greatest((F.size(F.array_distinct(low)) / F.greatest(F.size(tokens), F.lit(1)) - 0.25) / 0.40, F.lit(0.0)), F.lit(1.0))
    sums = F.struct(F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("xx"))
    n = F.greatest(F.size(sents), F.lit(1))

    def spread(a: Column) -> Column:
        """Standard deviation over mean, from exact sums."""
        return F.least(F.sqrt((n * a["xx"] - a["x"] * a["x"]).cast("double")) / n / F.greatest(a["x"] / n, F.lit(1.0)) / 0.5, F.lit(1.0))

    runs = lambda space: F.transform(sents, lambda s: (F.regexp_count(s, F.lit(space)) + 1).cast("bigint"))  # noqa: E731  sentences() has stripped them
    lengths = runs(jvm(f"{_SPACE}+")) if ascii is None else F.when(ascii, runs(r"[\t-\r\x1c- ]+")).otherwise(runs(jvm(f"{_SPACE}+")))
    if single is not None:
        lengths = F.when(single, F.transform(sents, lambda s: (F.octet_length(s) - F.octet_length(F.replace(s, F.lit(" "), F.lit(""))) + 1).cast("bigint"))).otherwise(lengths)
    relative = F.aggregate(lengths, sums, lambda a, x: F.struct((a["x"] + x).alias("x"), (a["xx"] + x * x).alias("xx")), spread)
    varied = F.when(F.size(sents) >= 3, relative).otherwise(F.lit(0.5))
    return F.when(F.size(tokens) < 10, F.lit(0.5)).otherwise(clamp(0.45 * connected + 0.40 * variety + 0.15 * varied))


def lookup(key: Column, values: dict, default) -> Column:
    """values[key], or default, without a join."""
    out = F.lit(default)
    for k, v in reversed(list(values.items())):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out
