"""Personal data in texts by weak supervision, with native columns only.

Patterns find the base spans. Beside them, looser forms are candidates: numbers and handles by their form,
persons and addresses by lists of given names, titles and words for streets. Labelers (patterns, gazetteers and
contexts) vote on every candidate: 1 for personal data, -1 against, 0 for no say. Expectation-maximisation over
the counts of vote combinations estimates how reliable each labeler is, without labels, and the posteriors
train a logistic classifier of spans; what the labelers saw is all that it sees, so it needs no more than
those counts, whose number is bounded by the kinds and labelers and not by the texts. Candidates that the
classifier accepts join the base spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.llm.spans import clear_of_base, matches

# The forms asked for. Possessive groups match the same and need no stack for each repetition.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

#: Looser forms; each is a kind of its own.
LOOSE = {
    "local_phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "handle": r"(?<![A-Za-z0-9._%+@-])@[A-Za-z0-9_]{3,30}(?![A-Za-z0-9_@.])",
}
KINDS_LOOSE = (*LOOSE, "person", "address")
#: Gazetteers, parameters of candidates(). Given names, places and words for streets of four languages; words that are no names.
NAMES = (
    "Adam", "Alice", "Andrea", "Anna", "Antonio", "Barbara", "Camille", "Carlos", "Carmen", "Charles", "Charlotte", "Christian", "Claire", "Claudia", "Daniel", "David", "Diego", "Elena", "Elizabeth", "Emily", "Emma",
    "Eric", "Eva", "Felix", "Francisco", "Frank", "Friedrich", "Hans", "Heinrich", "Helen", "Ines", "Isabel", "Jacques", "James", "Jan", "Javier", "Jean", "Jennifer", "John", "Jorge", "Juan", "Julia", "Karl", "Katharina",
    "Klaus", "Laura", "Lena", "Louis", "Lucas", "Lucia", "Luis", "Manuel", "Margaret", "Maria", "Marie", "Martin", "Mary", "Michael", "Miguel", "Monika", "Nicole", "Olivia", "Pablo", "Patricia", "Paul", "Pedro", "Peter",
    "Philippe", "Pierre", "Rachel", "Robert", "Rosa", "Sabine", "Sarah", "Sofia", "Stefan", "Susan", "Thomas", "Ursula", "Victor", "William", "Wolfgang",
)
PLACES = (
    "Amsterdam", "Barcelona", "Berlin", "Bern", "Birmingham", "Bogota", "Boston", "Brussels", "Chicago", "Cologne", "Dallas", "Denver", "Dresden", "Dublin", "Frankfurt", "Geneva", "Hamburg", "Houston", "Leipzig", "Lille",
    "Lima", "London", "Lyon", "Madrid", "Manchester", "Marseille", "Mexico City", "Miami", "Montreal", "Munich", "Nantes", "New York", "Nice", "Paris", "Philadelphia", "Phoenix", "Quito", "San Francisco", "Santiago",
    "Seattle", "Sevilla", "Stuttgart", "Toronto", "Toulouse", "Valencia", "Vienna", "Washington", "Zurich",
)
STREETS = ("Street", "St", "Avenue", "Ave", "Road", "Rd", "Lane", "Drive", "Boulevard", "Blvd", "Court", "Square", "Terrace")
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Senor", "Senora")
NOT_NAMES = (
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday", "University",
    "Institute", "Company", "Bank", "Museum", "Hospital", "Church", "Award", "Prize", "Act", "Island", "River", "Lake", "Hotel", "School", "College",
)
_NAME = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
_EDGE = r"(?<![\p{L}\p{N}])"
LABELERS = ("shape", "gazetteer", "cue", "counter_cue", "edge", "reserved")
_CUES = r"(?i)(?:tel|phone|fon|call|fax|mobile|mail|contact|card|visa|account|konto|iban|ssn|social|id|ip|host|server|address|user|name|write to|reach|signed|regards|lives at|resides at|ship to|deliver to|mr|mrs|ms|dr|prof|herr|frau)[^A-Za-z0-9]{0,4}(?:(?:is|no|nr|number|at|:|=)[^A-Za-z0-9]{0,4})?$"
_COUNTER = r"(?i)(?:version|v|order|invoice|isbn|page|section|chapter|figure|table|no\.|item|part|release|university of|institute of|lake|[$€£#])[^A-Za-z0-9]{0,2}$"
_RESERVED = r"(?i)@(?:example|test|localhost|invalid)(?:\.|$)|^(?:127|0|255)\.|^(?:000|666)|(?:^|[^0-9])(?:0{6,}|1{6,}|9{6,})"


def _any(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(words) + ")"


def listed_forms(names: tuple[str, ...], streets: tuple[str, ...]) -> dict[str, str]:
    """Candidates that lists propose: a listed given name or a title before a name; a number and a street, in either order."""
    # a look at the first character comes first: Java then tries the lists at few places only
    person = rf"(?=\p{{Lu}}){_EDGE}(?:{_any(names)}(?:\x20\p{{Lu}}\.)?(?:\x20{_NAME}){{1,2}}|(?<={_any(TITLES)}[\x20.]\x20?){_NAME}(?:\x20{_NAME}){{0,2}})(?!\p{{L}})"
    address = rf"(?=[0-9\p{{Lu}}]){_EDGE}(?:[0-9]{{1,5}}[a-z]?\x20(?:{_NAME}\x20){{1,3}}{_any(streets)}|\p{{Lu}}\p{{Ll}}{{1,30}}(?:stra(?:ß|ss)e|gasse|allee|platz|weg)\x20[0-9]{{1,4}}[a-z]?)(?![\p{{L}}\p{{N}}])"
    return {"person": person, "address": address}


SPAN = "struct<s:int,k:int,e:int,kind:string,m:string,votes:array<int>>"
SPANS = f"array<{SPAN}>"


def _luhn(m: Column) -> Column:
    """Whether the digits of m pass Luhn's test."""
    digits = F.transform(F.split(F.reverse(F.regexp_replace(m, "[^0-9]", "")), ""), lambda c: F.try_to_number(c, F.lit("9")).cast("int"))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _n_digits(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]", ""))


def _ip_valid(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike(r"^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _voted(cut: Column, found: Column, kind: str, order: int, names: tuple[str, ...], places: tuple[str, ...]) -> Column:
    """(s, k, e, kind, m, votes) of matches; cut: T.pieces() of the text."""
    vote = lambda yes, no=None: F.when(yes, F.lit(1)).otherwise(F.lit(0) if no is None else F.when(no, F.lit(-1)).otherwise(F.lit(0)))
    listed = rf"(?i)(?<![\p{{L}}]){_any(names)}(?![\p{{L}}])"
    located = rf"^[^\p{{L}}\p{{N}}]{{0,3}}(?:[0-9]{{5}}[^\p{{L}}\p{{N}}]{{1,3}})?{_any(places)}(?![\p{{L}}])"

    def one(x: Column) -> Column:
        m = x["m"]
        low = F.greatest(x["s"] - 24, F.lit(0))
        before, after = T.piece(cut, low, x["s"] - low), T.piece(cut, x["e"], F.lit(40))
        if kind == "address":
            known = vote(after.rlike(located))
        else:
            known = vote(m.rlike(listed), m.rlike(rf"(?:^|\x20){_any((*NOT_NAMES, *places))}(?:\x20|$)") if kind == "person" else None)
        votes = [
            vote(m.rlike(r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$|@[A-Za-z0-9-]+\.|^[A-Z]{2}[0-9]{2}|^\+|^[0-9]{1,5}[a-z]?\x20\p{Lu}"), m.rlike(r"^[0-9]{3}\.[0-9]{3}\.[0-9]{4}$")),
            known,
            vote(before.rlike(_CUES)),
            F.when(before.rlike(_COUNTER), F.lit(-1)).otherwise(F.lit(0)),
            vote(before.rlike(r"(?:^|[\s(\[{<>\"':;,=|])$") & after.rlike(r"^(?:$|[\s)\]}<>\"',;:.!?|*#$%&])"), before.rlike(r"[A-Za-z0-9_]$") | after.rlike(r"^[A-Za-z0-9_]")),
            F.when(m.rlike(_RESERVED), F.lit(-1)).otherwise(F.lit(0)),
        ]
        votes = F.array(*(v if j in _speaking(kind) else F.lit(0) for j, v in enumerate(votes)))
        return F.struct(x["s"].alias("s"), F.lit(order).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"), m.alias("m"), votes.alias("votes"))

    return F.transform(found, one)


def candidates(docs: DataFrame, text: str = "text", into: str = "__found", names: tuple[str, ...] = NAMES, places: tuple[str, ...] = PLACES, streets: tuple[str, ...] = STREETS) -> DataFrame:
    """docs with one more column: the base spans (k below 4), and the looser ones with the labelers' votes.

    names, places and streets are the gazetteers, lists of plain words.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    digits, forms = t.rlike("[0-9]"), LOOSE | listed_forms(names, streets)
    strict = [
        ("email", matches(t, EMAIL, t.contains("@"))),
        ("ip", F.filter(matches(t, IP, t.rlike(r"[0-9]\.[0-9]")), lambda x: _ip_valid(x["m"]))),
        ("card", F.filter(matches(t, CARD, t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")), lambda x: F.when(_n_digits(x["m"]).between(14, 19), _luhn(x["m"])).otherwise(F.lit(False)))),
        ("phone", F.filter(matches(t, PHONE, t.rlike(r"\+[0-9]")), lambda x: _n_digits(x["m"]).between(10, 15))),
    ]
    gates = {
        "local_phone": digits & t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"), "national_id": digits & t.rlike("-[0-9]{2}-"), "account": digits & t.rlike("[A-Z]{2}[0-9]{2}"), "handle": t.contains("@"),
        "person": t.rlike(rf"(?=[\p{{Lu}}])(?<![A-Za-z])(?:{_any(names)}\x20|{_any(TITLES)}[\x20.])"), "address": digits & t.rlike(r"[0-9][a-z]?\x20\p{Lu}|\p{Ll}\x20[0-9]"),
    }
    found = {**dict(strict), **{kind: matches(t, forms[kind], gates[kind]) for kind in KINDS_LOOSE}}
    return docs.withColumn(into, T.bound(T.pieces(t), lambda cut: F.concat(*(_voted(cut, m, kind, k, names, places) for k, (kind, m) in enumerate(found.items())))).cast(SPANS))


#: What a vote for or against is taken to weigh before anything is known, and the odds of a span without votes.
_FIRST = {"shape": (0.4, 1.0), "gazetteer": (1.2, 1.5), "cue": (1.2, 0.0), "counter_cue": (0.0, 2.5), "edge": (0.2, 1.5), "reserved": (0.0, 2.0)}
_FIRST_BIAS = -0.5
#: Labelers that know some kinds only.
_ONLY = {"gazetteer": ("person", "address"), "shape": ("local_phone", "national_id", "account", "address"), "reserved": ("local_phone", "national_id", "account", "handle")}


def _speaking(kind: str) -> list[int]:
    """Labelers that vote on a kind; base spans stay without."""
    return [j for j, l in enumerate(LABELERS) if kind not in KINDS and kind in _ONLY.get(l, (kind,))]


def _em(table: list[tuple[str, tuple[int, ...], int]], rounds: int = 25) -> list[float]:
    """Posterior of personal data for each (kind, votes, count): votes, no say of a labeler that knows the kind among them, depend on the class alone."""
    sigmoid = lambda x: 1 / (1 + math.exp(-min(max(x, -30), 30)))
    post = [sigmoid(_FIRST_BIAS + sum(_FIRST[l][v < 0] * v for j, (l, v) in enumerate(zip(LABELERS, votes)) if j in _speaking(kind))) for kind, votes, _ in table]
    kinds = sorted({k for k, _, _ in table})
    for _ in range(rounds):
        prior = {k: [1.0, 1.0] for k in kinds}
        vote = [[{-1: 1.0, 0: 1.0, 1: 1.0} for _ in LABELERS] for y in range(2)]
        for (kind, votes, n), p in zip(table, post):
            for y, share in ((1, p), (0, 1 - p)):
                prior[kind][y] += n * share
                for j in _speaking(kind):
                    vote[y][j][votes[j]] += n * share
        post = []
        for kind, votes, _ in table:
            odds = math.log(prior[kind][1] / prior[kind][0])
            for j, v in ((j, votes[j]) for j in _speaking(kind)):
                odds += math.log(vote[1][j][v] / sum(vote[1][j].values())) - math.log(vote[0][j][v] / sum(vote[0][j].values()))
            post.append(sigmoid(odds))
    return post


def _features(kind: str, votes: tuple[int, ...], kinds: list[str]) -> list[float]:
    return [1.0, *(float(kind == k) for k in kinds), *(float(v == s and j in _speaking(kind)) for j, v in enumerate(votes) for s in (1, -1))]


def _logistic(rows: list[tuple[list[float], float, float]], ridge: float = 1.0, rounds: int = 12) -> list[float]:
    """Weights by Newton's method for (features, target share, weight)."""
    d = len(rows[0][0])
    w = [0.0] * d
    for _ in range(rounds):
        grad, hess = [-ridge * x for x in w], [[ridge * (i == j) for j in range(d)] for i in range(d)]
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-min(max(sum(a * b for a, b in zip(w, x)), -30), 30)))
            on = [i for i in range(d) if x[i]]
            for i in on:
                grad[i] += n * (y - p) * x[i]
                for j in on:
                    hess[i][j] += n * p * (1 - p) * x[i] * x[j]
        for i in range(d):  # elimination; hess is positive definite
            for r in range(i + 1, d):
                f = hess[r][i] / hess[i][i]
                if f:
                    for c in range(i, d):
                        hess[r][c] -= f * hess[i][c]
                    grad[r] -= f * grad[i]
        step = [0.0] * d
        for i in reversed(range(d)):
            step[i] = (grad[i] - sum(hess[i][c] * step[c] for c in range(i + 1, d))) / hess[i][i]
        w = [a + b for a, b in zip(w, step)]
    return w


def fit(found: DataFrame, column: str = "__found") -> dict:
    """The span classifier, from the counts of all candidates' votes; base spans need none, no candidates give one that accepts none."""
    counted = found.select(F.explode(column).alias("x")).where(F.col("x.k") >= len(KINDS)).groupBy(F.col("x.kind").alias("kind"), F.col("x.votes").alias("votes")).agg(F.count("*").alias("n"))
    table = sorted((r["kind"], tuple(r["votes"]), r["n"]) for r in counted.collect())  # at most 10 kinds * 3 ** 6 combinations
    if not table:
        return {"bias": -30.0, "kinds": {}, "votes": [{1: 0.0, -1: 0.0, 0: 0.0} for _ in LABELERS]}
    kinds = sorted({k for k, _, _ in table})
    rows = [(_features(k, v, kinds), p, float(n)) for (k, v, n), p in zip(table, _em(table))]
    w = _logistic(rows)
    at = 1 + len(kinds)
    return {"bias": w[0], "kinds": dict(zip(kinds, w[1:at])), "votes": [{1: w[at + 2 * j], -1: w[at + 2 * j + 1], 0: 0.0} for j in range(len(LABELERS))]}


def accepted(found: Column, model: dict, threshold: float = 0.5) -> Column:
    """The base spans, and the candidates that the classifier accepts and no base span overlaps, sorted."""
    bias = {k: model["bias"] + model["kinds"].get(k, 0.0) for k in KINDS_LOOSE}
    cut = math.log(threshold / (1 - threshold))

    def score(x: Column) -> Column:
        total = F.lit(-1e9)
        for kind, b in bias.items():
            total = F.when(x["kind"] == kind, F.lit(b)).otherwise(total)
        for j, by in enumerate(model["votes"]):
            total = total + F.element_at(F.array(F.lit(by[-1]), F.lit(by[0]), F.lit(by[1])), F.element_at(x["votes"], j + 1) + 2)
        return total

    return F.when(F.size(found) == 0, found).otherwise(clear_of_base(F.filter(found, lambda x: (x["k"] < len(KINDS)) | (score(x) >= cut)), len(KINDS), SPAN))


def find_pii(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and spans: arrays of (s, k, e, kind, m, votes), sorted; base has the patterns' spans, spans all.

    A null text is empty and has none; spans of the base kinds stay whatever the classifier says. Repeated
    rows stay and count as often; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("__text"))
    found = candidates(rows, "__text").select("doc_id", "__found")
    model = fit(found)
    return found.select("doc_id", F.array_sort(F.filter("__found", lambda x: x["k"] < len(KINDS))).alias("base"), accepted(F.col("__found"), model).alias("spans"))
