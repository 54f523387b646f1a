"""Personal data by weak supervision, in DataFrame functions only.

Base patterns give the spans that always stay (email, ip, card, phone).  Looser patterns propose more:
telephone numbers without a country code, quoted secrets, long numbers.  Four labelers vote on
every proposed or base span (+1, 0 or -1): its *shape*, a *gazetteer* of prefixes and endings, cue words
in its *context*, and the make-up of its *characters*.  Expectation-maximisation over the table of vote
patterns estimates how reliable each labeler is and how likely each pattern is personal data; with
these as soft labels a logistic span classifier is fitted on span features, and
decides on the proposed spans.

The vote table has at most kinds x 3**4 x feature cells rows, whatever the input: only it leaves the executors.

Offsets are code points.  They come from the lengths of what a pattern matches and of what lies between the
matches, summed up in slices, so that a text with very many matches takes no quadratic time.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# The base patterns' kinds, in the order that spans are listed by.
KINDS = ("email", "ip", "card", "phone", "secret", "number")
BASE = KINDS[:4]

_LOCAL = r"A-Za-z0-9._%+-"
#: Each begins only where a leftmost search would begin, and never backs up: linear time on any text.
_EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Whole runs of digits with single separators, of as many digits as pass.
_RUN = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){%d,%d}+(?![\x20-]?[0-9])"
_CARD = _RUN % (11, 18)
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_LOCAL_PHONE = r"(?<![0-9+(])\(?[2-9][0-9]{2}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
_SECRET = r"\"[A-Za-z0-9+/_=-]{16,}+\""
_NUMBER = _RUN % (8, 18)
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

#: Words before a span that speak for personal data, and against it (English, German, French, Spanish).
_CUES = r"token|key|passw|secret|phone|tel|call|mobil|card|karte|carte|tarjeta|account|konto|compte|cuenta|mail|contact|kontakt|address|ip\b|ssn|iban"
_AGAINST = r"version|isbn|page|seite|©|figure|total|copyright|license|chapter"
#: Gazetteers: endings of mail domains, leading digits of issued cards, reserved address blocks.
_ENDINGS = r"\.(?:com|org|net|edu|gov|de|fr|es|uk|eu|io|info|biz)$"
_ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|36|30)"
_RESERVED = r"^(?:0|10|127|255|22[4-9]|23[0-9]|24[0-9]|25[0-4])\."

_SLICE = 512


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass Luhn's check."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: F.coalesce(F.expr("try_cast(NULL as int)"), d.try_cast("int")))
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).when(v > 4, 2 * v - 9).otherwise(2 * v))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def _matches(text: Column, pattern: str, present: Column) -> Column:
    """Matches of a pattern as structs of gap length, length, the match and what stands before it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    # Zipped, as a function over ``found`` would split the text again for each of its matches.
    zipped = F.zip_with(
        found,
        gaps,
        lambda m, gap: F.struct(
            F.length(gap).cast("long").alias("gap"),
            F.length(m).cast("long").alias("size"),
            m.alias("match"),
            F.lower(F.substring(gap, -40, 40)).alias("before"),
        ),
    )
    return F.when(present, F.filter(zipped, lambda s: s["match"].isNotNull()))  # what follows the last match is nobody's gap


def _placed(name: str) -> Column:
    """The matches of column ``name`` with start and end, by running sums within slices."""
    all_ = F.col(name)
    many = F.greatest(F.ceil(F.size(all_) / _SLICE).cast("int"), F.lit(1))
    nothing = F.expr("cast(array() as array<struct<start:bigint,end:bigint,match:string,before:string>>)")

    def slice_(k: Column) -> Column:
        offset = F.aggregate(F.slice(all_, F.lit(1), k * _SLICE), F.lit(0).cast("long"), lambda a, m: a + m["gap"] + m["size"])
        return F.aggregate(
            F.slice(all_, k * _SLICE + 1, F.lit(_SLICE)),
            F.struct(offset.alias("at"), nothing.alias("out")),
            lambda a, m: F.struct(
                (a["at"] + m["gap"] + m["size"]).alias("at"),
                F.concat(
                    a["out"],
                    F.array(
                        F.struct(
                            (a["at"] + m["gap"]).alias("start"),
                            (a["at"] + m["gap"] + m["size"]).alias("end"),
                            m["match"].alias("match"),
                            m["before"].alias("before"),
                        )
                    ),
                ).alias("out"),
            ),
            lambda a: a["out"],
        )

    return F.when(F.coalesce(F.size(all_), F.lit(0)) > 0, F.flatten(F.transform(F.sequence(F.lit(0), many - 1), slice_))).otherwise(nothing)


def _votes(kind: str, span: Column) -> list[Column]:
    """Votes of the four labelers on one span."""
    text, before = span["match"], span["before"]
    digits = _digits(text)
    yes, no, none = F.lit(1), F.lit(-1), F.lit(0)
    n = F.length(digits)
    shape = {
        "email": F.when(text.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}$"), yes).otherwise(no),
        "ip": F.when(text.rlike(r"^(?:[1-9][0-9]{0,2}|0)(?:\.(?:[1-9][0-9]{0,2}|0)){3}$"), yes).otherwise(no),
        "card": F.when(text.rlike(r"^(?:[0-9]{4}[ -]?){3,4}[0-9]{0,4}$"), yes).otherwise(none),
        "phone": F.when(text.rlike(r"[0-9]{3}[ .-][0-9]{4}$"), yes).otherwise(none),
        "secret": F.when(text.rlike(r"^\"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[A-Za-z0-9+/_-]{20,})=*\"$"), yes).otherwise(none),
        "number": F.when(n >= 13, yes).when(n < 10, no).otherwise(none),
    }[kind]
    gazetteer = {
        "email": F.when(F.lower(text).rlike(_ENDINGS), yes).otherwise(none),
        "ip": F.when(text.rlike(_RESERVED), no).otherwise(yes),
        "card": F.when(digits.rlike(_ISSUERS), yes).otherwise(none),
        "phone": F.when(digits.rlike(r"^1?[2-9][0-9]{9}$"), yes).when(n < 9, no).otherwise(none),
        "secret": F.when(text.rlike(r"^\"(?:sk|pk|ghp|xox|AKIA|eyJ)"), yes).otherwise(none),
        "number": F.when(digits.rlike(_ISSUERS), yes).when(digits.rlike(r"^(?:19|20)[0-9]{2}"), no).otherwise(none),
    }[kind]
    context = F.when(before.rlike(_AGAINST), no).when(before.rlike(_CUES), yes).otherwise(none)
    distinct = F.size(F.array_distinct(F.split(F.regexp_replace(text, r"[^A-Za-z0-9]", ""), "")))
    characters = {
        "email": F.when(distinct >= 5, yes).otherwise(none),
        "ip": F.when(F.size(F.array_distinct(F.split(text, r"\."))) >= 3, yes).otherwise(no),
        "card": F.when(_luhn(digits), yes).otherwise(no),
        "phone": F.when(distinct >= 5, yes).when(distinct < 3, no).otherwise(none),
        "secret": F.when(distinct >= 9, yes).when(distinct < 6, no).otherwise(none),
        "number": F.when(distinct >= 6, yes).when(distinct < 4, no).otherwise(none),
    }[kind]
    return [shape, gazetteer, context, characters]


#: Features of the span classifier besides its kind: bounded cells.
_FEATURES = ("long", "varied", "cued", "against", "digits")


def _features(span: Column) -> list[Column]:
    text, before = span["match"], span["before"]
    distinct = F.size(F.array_distinct(F.split(text, "")))
    return [
        F.least(F.floor(F.length(text) / 8), F.lit(4)).cast("int"),
        F.least(F.floor(distinct / 4), F.lit(4)).cast("int"),
        before.rlike(_CUES).cast("int"),
        before.rlike(_AGAINST).cast("int"),
        F.floor(4 * F.length(_digits(text)) / F.greatest(F.length(text), F.lit(1))).cast("int"),
    ]


def _labelled(spans: Column, kind: str, base: bool) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("kind"),
            s["end"].alias("end"),
            F.lit(base).alias("base"),
            F.array(*[v.cast("int") for v in _votes(kind, s)]).alias("votes"),
            F.array(*_features(s)).alias("features"),
        ),
    )


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and all base and proposed spans of each row with their votes and features."""
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    t = F.col("t")
    digit, at = t.rlike("[0-9]"), F.instr(t, "@") > 0
    df = df.select("doc_id", "t", digit.alias("digit"), at.alias("at"))
    digit = F.col("digit")
    found = df.select(
        "doc_id",
        _matches(t, _EMAIL, F.col("at")).alias("email"),
        _matches(t, _IP, digit & t.rlike(r"[0-9]\.[0-9]")).alias("ip"),
        _matches(t, _NUMBER, digit).alias("number"),
        _matches(t, _PHONE, digit & (F.instr(t, "+") > 0)).alias("phone"),
        _matches(t, _LOCAL_PHONE, digit).alias("local"),
        _matches(t, _SECRET, F.instr(t, '"') > 0).alias("secret"),
    )
    placed = found.select("doc_id", *[_placed(c).alias(c) for c in ("email", "ip", "number", "phone", "local", "secret")])
    count = lambda s: F.length(_digits(s["match"]))
    is_card = lambda s: (count(s) >= 12) & (count(s) <= 19) & _luhn(_digits(s["match"]))
    # Both are whole runs of digits: a run that passes as a card is one, any other is a number.
    chosen = placed.select(
        "doc_id",
        "email",
        F.filter("ip", lambda s: s["match"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")).alias("ip"),
        F.filter("number", is_card).alias("card"),
        F.filter("phone", lambda s: (count(s) >= 9) & (count(s) <= 15)).alias("phone"),
        F.filter("number", lambda s: ~is_card(s) & ~s["before"].rlike("[a-z_]$")).alias("number"),  # no part of a longer token
        "local",
        "secret",
    )
    base = F.concat(*[_labelled(F.col(k), k, True) for k in BASE])
    more = F.concat(_labelled(F.col("local"), "phone", False), _labelled(F.col("secret"), "secret", False), _labelled(F.col("number"), "number", False))
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    within = lambda a, b: (b["start"] <= a["start"]) & (a["end"] <= b["end"])
    number = KINDS.index("number")
    # A proposal stands aside for a base span, unless it is the wider one, and a number for anything more particular.
    fine = lambda m: ~F.exists("base", lambda b: meets(m, b) & (within(m, b) | ~within(b, m))) & ~(
        (m["kind"] == number) & (F.exists("base", lambda b: meets(m, b)) | F.exists("more", lambda o: (o["kind"] != number) & meets(m, o)))
    )
    return chosen.select("doc_id", F.array_sort(base).alias("base"), more.alias("more")).select("doc_id", "base", F.filter("more", fine).alias("more"))


def reliabilities(table: list[tuple[int, tuple[int, ...], float]], rounds: int = 60) -> tuple[np.ndarray, list[float]]:
    """Expectation-maximisation of a model of independent labelers over vote patterns.

    ``table`` has (kind, votes, count).  A labeler that votes is right with a probability of its own, and says nothing by
    abstaining; it is never taken to be worse than chance, which settles which class is which.  Returns the labelers'
    reliabilities and each pattern's probability of being personal data.
    """
    kinds = np.array([k for k, _, _ in table])
    votes = np.array([v for _, v, _ in table], dtype=float).reshape(len(table), -1)
    count = np.array([c for _, _, c in table], dtype=float)
    post = 1 / (1 + np.exp(-1.5 * votes.sum(1)))  # begins at the majority
    right = np.full(votes.shape[1], 0.7)
    for _ in range(rounds):
        for j in range(votes.shape[1]):
            agrees = (count * np.where(votes[:, j] > 0, post, 1 - post))[votes[:, j] != 0].sum()
            right[j] = np.clip((agrees + 2) / (count[votes[:, j] != 0].sum() + 3), 0.5, 0.99)
        prior = np.full(len(KINDS), 0.5)
        for k in set(kinds.tolist()):
            here = kinds == k
            prior[k] = (1 + (count * post)[here].sum()) / (2 + count[here].sum())
        odds = np.log(prior[kinds] / (1 - prior[kinds])) + votes @ np.log(right / (1 - right))
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return right, post.tolist()


def _design(kind: int, features: tuple[int, ...]) -> list[float]:
    return [1.0, *[float(kind == k) for k in range(len(KINDS))], *[float(f) for f in features]]


def classifier(rows: list[tuple[int, tuple[int, ...], float, float]]) -> list[float]:
    """Logistic weights for (kind, features) cells with (mass, probability): ridge, by Newton's method."""
    width = 1 + len(KINDS) + len(_FEATURES)
    if not rows:
        return [-1.0] + [0.0] * (width - 1)
    x = np.array([_design(k, f) for k, f, _, _ in rows])
    mass, y = np.array([m for _, _, m, _ in rows]), np.array([p for _, _, _, p in rows])
    mass = mass / max(1.0, mass.sum() / 10_000)
    w = np.zeros(width)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (mass * p * (1 - p))[:, None]).T @ x + np.eye(width), x.T @ (mass * (p - y)) + w)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return [float(v) for v in w]


def train(found: DataFrame) -> list[float]:
    """Weights of the span classifier from all spans of all documents, by their vote table."""
    spans = found.select(F.explode(F.concat("base", "more")).alias("s")).select("s.kind", "s.votes", "s.features")
    table = sorted((r.kind, tuple(r.votes), tuple(r.features), float(r.n)) for r in spans.groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).alias("n")).collect())
    if not table:
        return classifier([])
    by_votes: dict[tuple[int, tuple[int, ...]], float] = {}
    for kind, votes, _, n in table:
        by_votes[kind, votes] = by_votes.get((kind, votes), 0.0) + n
    patterns = sorted(by_votes)
    _, post = reliabilities([(k, v, by_votes[k, v]) for k, v in patterns])
    likely = dict(zip(patterns, post, strict=True))
    cells: dict[tuple[int, tuple[int, ...]], list[float]] = {}
    for kind, votes, features, n in table:
        cell = cells.setdefault((kind, features), [0.0, 0.0])
        cell[0] += n
        cell[1] += n * likely[kind, votes]
    return classifier([(k, f, m, s / m) for (k, f), (m, s) in sorted(cells.items())])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``base`` and ``spans`` of every row of ``docs``.

    Both are arrays of (start, kind, end) ordered by start, then kind; ``kind`` is a number in ``KINDS``.
    ``spans`` holds the base spans and the proposed ones that the classifier accepts; those that overlap
    a base span are accepted only if they contain it.  Null and empty texts have no spans.  Rows are independent but for
    the classifier: repeated rows and null ids come back as they are.  Texts of any length are read whole.  Other columns are
    never read, whatever their names.
    """
    found = stored(candidates(docs, id_col, text_col), "pii-spans")
    w = train(found)

    def likely(s: Column) -> Column:
        by_kind = F.element_at(F.array(*[F.lit(w[1 + k]) for k in range(len(KINDS))]), s["kind"] + 1)
        total = F.lit(w[0]) + by_kind
        for i in range(len(_FEATURES)):
            total = total + F.lit(w[1 + len(KINDS) + i]) * F.element_at(s["features"], i + 1)
        return total >= math.log(0.5 / 0.5)

    plain = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    base = F.transform("base", plain)
    return found.select("doc_id", base.alias("base"), F.array_sort(F.concat(base, F.transform(F.filter("more", likely), plain))).alias("spans"))


def _listed(c: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: int) -> Column:
    """How many base spans are of a kind."""
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def op10_pii(spark, sf_dir: str) -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans of every document."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[_count(k).alias(f"n_{name}") for k, name in enumerate(BASE)],
        F.sha2(_listed("base"), 256).alias("base_sha256"),
        _listed("spans").alias("spans"),
    )
