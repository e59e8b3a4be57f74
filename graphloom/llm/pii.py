"""Personal data by candidate gradient boosting, in DataFrame functions only.

Four validated patterns give the base spans. Generators with high recall
propose further spans, mailboxes with disguised at signs and runs of digits, where
no base span stands. Boosted trees score a proposal by its format and its context.

What the base patterns cannot see has no labels, so these are made: base spans are
rewritten into forms that no base pattern matches (positive), the same forms are
spoilt (a wrong check digit, a part over 255, too few digits, a host without a
domain; negative), and proposals inside a longer word are negative. Other proposals
have no label and are not fitted. A fifth of all these, over the whole table, is held
out: their counts by generator and score make an isotonic calibration, in which as many of the proposals as ``PRIOR``
lets expect count as positive, and proposals of at least ``PROBABILITY`` are selected.
The trees become SQL, so proposals are scored inside their row: no text and no span
is shuffled.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import cut

KINDS = ("email", "ip", "card", "phone", "more")

#: The base patterns; possessive repeats and the look-behind change no match, but bound the time and the stack.
BASE = {
    "email": (r"@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9][\x20-]?[0-9]", r"[0-9](?:[\x20-]?[0-9]){11,}+"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_IN = r"[^\s@()\[\]{}<>,;:\x22\x27]"
#: Proposals: what is written around an at sign or its usual disguises, and runs of digits with separators.
GENERATORS = {
    "mailbox": (
        r"@|[(\[{]\s?at\s?[)\]}]|\x20dot\x20",
        rf"(?<!{_IN}){_IN}++(?:@|\s?[(\[{{]\s?at\s?[)\]}}]\s?|\x20at\x20(?={_IN}++\x20dot\x20)){_IN}++(?:(?:\s?[(\[{{]\s?dot\s?[)\]}}]\s?|\x20dot\x20){_IN}++){{0,8}}+",
    ),
    "number": (r"[0-9][0-9\x20().\-/]{5}", r"(?<![0-9])\+?\(?[0-9][0-9\x20().\-/]*+"),
}
#: Digits that a proposed number has; no kind of number that is sought has fewer or more.
DIGITS = (7, 19)
CONTEXTS = (
    r"(?i)call|tel|phone|fax|mobile|contact|reach|dial|sms",
    r"(?i)card|visa|pay|iban|account|amex|master",
    r"(?i)host|server|ip\b|addr|subnet|login",
    r"(?i)mail|write to|e-mail|contact|reply",
)
#: About so many labelled spans, those of the lowest hashes, half of each label, are fitted; the calibration counts all held-out ones.
SAMPLE = 20_000
#: A selected proposal is personal data with at least this calibrated probability.
PROBABILITY = 0.9
#: How many disguised spans are expected for each plain one.
PRIOR = 0.5


def _let(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once."""
    return F.transform(F.array(value), fn)[0]


def _running(x: Column, add) -> Column:
    """Running sums (or maxima) of an array of longs by doubling: n log n steps, whatever its length."""
    def step(acc: Column, k: Column) -> Column:
        gap = F.pow(F.lit(2), k).cast("int")
        moved = F.concat(F.array_repeat(F.lit(None).cast("long"), gap), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - gap, F.lit(0))))
        return F.zip_with(acc, F.slice(moved, F.lit(1), F.size(acc)), lambda a, b: F.when(b.isNull(), a).otherwise(add(a, b)))

    steps = lambda n: F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int"))
    return _let(x, lambda y: F.aggregate(steps(F.size(y)), y, step))


_STEPS = [1 << k for k in reversed(range(31))]


def _below(starts: Column, x: Column) -> Column:
    """How many of the sorted ``starts`` are less than x."""
    steps = F.array(*map(F.lit, _STEPS))
    return F.aggregate(steps, F.lit(0), lambda p, s: F.when((s <= F.size(starts) - p) & (F.get(starts, p + s - 1) < x), p + s).otherwise(p))


def _apart(found: Column, taken: Column) -> Column:
    """The spans of ``found`` that overlap none of ``taken``, which is sorted by start."""
    ends = _running(F.transform(taken, lambda t: t["end"]), F.greatest)
    sides = F.struct(F.transform(taken, lambda t: t["start"]).alias("starts"), ends.alias("ends"))
    free = lambda b: lambda c: ~F.coalesce(F.get(b["ends"], _below(b["starts"], c["end"]) - 1) > c["start"], F.lit(False))
    return _let(sides, lambda b: F.filter(found, free(b)))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    def worth(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    every = F.transform(F.sequence(F.lit(0), F.length(digits) - 1), worth)
    return (F.length(digits) > 0) & (F.aggregate(every, F.lit(0), lambda a, x: a + x) % 10 == 0)


_VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.try_to_number(F.ltrim(p, F.lit("0")), F.lit("999")), F.lit(0)) <= 255)),
    "card": lambda m: F.length(_digits(m)).between(12, 19) & luhn(_digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}


def _found(text: str, trigger: str, pattern: str) -> Column:
    """(start, end, m, before, after) of each leftmost match, in code points; null where the trigger never matches.

    ``before`` is what stands before it back to the match before, 24 characters
    at most, ``after`` the next character. They come from the pieces between
    matches, so that no match is sought in the whole text again.
    """
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"), F.split(text, pattern, -1).alias("gap"))
    long = lambda x: F.char_length(x).cast("long")

    def place(x: Column) -> Column:
        n = F.size(x["m"])
        ahead, behind = F.slice(x["gap"], F.lit(1), n), F.slice(x["gap"], F.lit(2), n)
        ends = _running(F.zip_with(ahead, x["m"], lambda g, m: long(g) + long(m)), lambda a, b: a + b)
        every = F.arrays_zip(x["m"].alias("m"), ends.alias("end"), ahead.alias("ahead"), behind.alias("behind"))
        return F.transform(every, lambda z: F.struct((z["end"] - long(z["m"])).alias("start"), z["end"].alias("end"), z["m"].alias("m"), F.right(z["ahead"], F.lit(24)).alias("before"), F.left(z["behind"], F.lit(1)).alias("after")))

    return F.when(F.col(text).rlike(trigger), _let(parts, place))


_SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"
_TEXT = "array<struct<start:bigint,rank:int,end:bigint,kind:string,m:string,before:string,after:string>>"
_PROPOSAL = "array<struct<start:bigint,end:bigint,generator:string,f:array<double>>>"
_MADE = "array<struct<generator:string,label:double,f:array<double>>>"


_MAILBOX, _NUMBER = 0, 1


def _features(m: Column, before: Column, after: Column, generator: int) -> list[Column]:
    count = lambda p: (F.length(m) - F.length(F.regexp_replace(m, p, ""))).cast("double")
    yes = lambda x: F.when(x, 1.0).otherwise(0.0)
    groups = F.split(m, "[^0-9]+")
    dotted = m.rlike(r"(?:@|\bat[)\]}]|\x20at\x20)\s?[^@.\s]++(?:\.|\x20dot\x20|\s?[(\[{]\s?dot)")
    number = lambda x: x if generator == _NUMBER else F.lit(0.0)
    # a mailbox is not told by how long it is or how many digits and dots it has. Of features that tell labels apart equally well trees take the first: what a kind of data has to have comes before how it is written
    return [
        yes(before.rlike(r"\w$")),
        yes(after.rlike(r"\w")),
        yes(dotted),
        yes(F.when(F.length(_digits(m)).between(12, 19), luhn(_digits(m))).otherwise(False)),
        F.size(F.filter(groups, lambda g: (F.length(g) >= 3) & ((F.length(g) > 3) | (g > "255")))).cast("double"),
        number(count("[0-9]")),
        number(F.array_max(F.transform(groups, F.length)).cast("double")),
        number(F.size(F.filter(groups, lambda g: g != "")).cast("double")),
        number(count(r"\.")),
        number(count("-")),
        number(count("/")),
        count(r"\s"),
        count("[()]"),
        yes(m.startswith("+")),
        yes(m.contains("@")),
        *(yes(before.rlike(p)) for p in CONTEXTS),
        F.lit(float(generator)),
    ]


WIDTH = 16 + len(CONTEXTS)
#: The feature of a word character before a span; the next one is of one behind it.
_INSIDE = 0


def disguised(kind: Column, m: Column) -> Column:
    """A base span's text in one of three forms, by its hash, that no base pattern matches."""
    way = F.pmod(F.xxhash64(m), F.lit(3))
    pick = lambda a, b, c: F.when(way == 0, a).when(way == 1, b).otherwise(c)
    digits = _digits(m)
    last = F.substring(digits, F.greatest(F.length(digits) - 9, F.lit(1)), F.lit(10))
    phone = lambda to: F.regexp_replace(last, r"^([0-9]{3})([0-9]{3})(?=[0-9])", to)
    card = lambda sep: F.regexp_replace(digits, r"([0-9]{4})(?=[0-9])", f"$1{sep}")
    dots = F.regexp_replace(F.regexp_replace(m, "@", " at "), r"\.", " dot ")
    return (
        F.when(kind == "email", pick(F.regexp_replace(m, "@", " [at] "), F.regexp_replace(m, "@", "(at)"), dots))
        .when(kind == "phone", pick(phone("$1-$2-"), phone("$1.$2."), phone("($1) $2-")))
        .when(kind == "card", pick(card("."), card("/"), card("  ")))
        .otherwise(pick(F.regexp_replace(m, r"\.", "-"), F.regexp_replace(m, r"\.", "/"), F.regexp_replace(m, r"\.", " . ")))
    )


def spoilt(kind: Column, m: Column) -> Column:
    """A disguised text that is no personal data any more."""
    tail = F.substring(m, F.length(m), F.lit(1))
    wrong = F.concat(F.substring(m, F.lit(1), F.length(m) - 1), F.pmod(F.coalesce(tail.try_cast("int"), F.lit(0)) + 1, F.lit(10)).cast("string"))
    host = F.regexp_replace(m, r"((?:\[at\]|\(at\)|\x20at\x20)\s?[^.\s]++)[.\s].*+$", "$1")
    return F.when(kind == "email", host).when(kind == "card", wrong).when(kind == "phone", F.concat(F.substring(m, F.lit(1), F.lit(5)), F.lit("00"))).otherwise(F.concat(F.lit("9"), F.lpad(m, F.length(m) + 1, "3")))


def propose(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append ``base`` (start, rank, end, kind) by start and kind, ``proposals`` that overlap none of these, and ``made``, labelled examples.

    Null and empty texts have none; equal texts have equal ones; time grows as n log n with a
    text's matches. Columns of these names are replaced.
    """
    def base(rank: int, kind: str) -> Column:
        good = F.filter(_found(text, *BASE[kind]), lambda s: _VALID[kind](s["m"]))
        as_span = lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["m"].alias("m"), s["before"].alias("before"), s["after"].alias("after"))
        return F.coalesce(F.transform(good, as_span), F.array().cast(_TEXT))

    def proposals(n: int, name: str) -> Column:
        found = _found(text, *GENERATORS[name])
        if name == "number":
            trimmed = F.transform(found, lambda c: _let(F.rtrim(c["m"], F.lit(" ().-/")), lambda m: F.struct(c["start"].alias("start"), (c["start"] + F.char_length(m)).alias("end"), m.alias("m"), c["before"].alias("before"), F.when(m == c["m"], c["after"]).otherwise(" ").alias("after"))))
            found = F.filter(trimmed, lambda c: F.length(_digits(c["m"])).between(*DIGITS))
        found = _let(found, lambda f: F.when(F.size(f) > 0, _apart(f, F.col("__base__"))))
        feats = lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit(name).alias("generator"), F.array(*_features(c["m"], c["before"], c["after"], n)).alias("f"))
        return F.coalesce(F.transform(found, feats), F.array().cast(_PROPOSAL))

    def made(b: Column) -> Column:
        """A disguised and a spoilt example of a base span, in its context."""
        both = _let(disguised(b["kind"], b["m"]), lambda m: F.array(F.struct(m.alias("m"), F.lit(1.0).alias("label")), F.struct(spoilt(b["kind"], m).alias("m"), F.lit(0.0).alias("label"))))
        mail = b["kind"] == "email"
        feats = lambda x, n: F.array(*_features(x["m"], b["before"], b["after"], n))
        return F.transform(both, lambda x: F.struct(F.when(mail, "mailbox").otherwise("number").alias("generator"), x["label"].alias("label"), F.when(mail, feats(x, _MAILBOX)).otherwise(feats(x, _NUMBER)).alias("f")))

    out = docs.withColumn("__base__", F.array_sort(F.concat(*(base(*x) for x in enumerate(BASE)))))
    out = out.withColumns({"proposals": F.concat(*(proposals(*x) for x in enumerate(GENERATORS))), "made": F.coalesce(F.flatten(F.transform("__base__", made)), F.array().cast(_MADE))})
    return out.withColumn("base", F.transform("__base__", lambda b: F.struct(*(b[c].alias(c) for c in ("start", "rank", "end", "kind"))))).drop("__base__")


def _tree_sql(lines: list[str], f: str) -> str:
    """A tree's printed form as nested CASE expressions."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return f"{float(line.split(':')[1])!r}D"
    i, value = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    yes = _tree_sql(lines, f)
    lines.pop(0)
    return f"CASE WHEN {f}[{i}] <= {float(value)!r}D THEN {yes} ELSE {_tree_sql(lines, f)} END"


def model_sql(model: GBTClassificationModel, f: str) -> str:
    """The ensemble's score as SQL on the feature array ``f``."""
    sums = [f"{w!r}D * ({_tree_sql(t.toDebugString.splitlines()[1:], f)})" for t, w in zip(model.trees, model.treeWeights, strict=True)]
    return f"1 / (1 + exp(-2 * ({' + '.join(sums)})))"


def calibrated(bins: list[tuple[int, float, float]]) -> list[tuple[int, float]]:
    """(bin, probability) that does not fall as bins rise, from (bin, positives, negatives): neighbours that do are pooled."""
    pools: list[list] = []
    for p, good, bad in sorted(bins):
        pools.append([good, bad, [p]])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            g, b, ps = pools.pop()
            pools[-1] = [pools[-1][0] + g, pools[-1][1] + b, pools[-1][2] + ps]
    return [(p, g / (g + b)) for g, b, ps in pools for p in ps]


def learn(rows: DataFrame, sample: int = SAMPLE, probability: float = PROBABILITY, prior: float = PRIOR) -> tuple[str, dict[str, float]]:
    """(SQL of the score of ``c``, least score of each generator), from rows with ``proposals`` and ``made``.

    Labelled spans of the whole table in one fifth of the hashes are held out, and
    a count by generator and score of these calibrates the score. The trees are
    fitted to others, about ``sample`` of the lowest hashes. Without both labels
    there nothing is selected.
    """
    made = F.transform("proposals", lambda c: F.struct(c["generator"].alias("generator"), F.lit(None).cast("double").alias("label"), c["f"].alias("f")))
    each = rows.filter("size(proposals) + size(made) > 0").select(F.xxhash64("proposals", "made").alias("row"), F.concat("made", made).alias("every"))
    each = each.select("row", F.posexplode("every").alias("i", "c"))
    each = cut(each.select("c.*", F.xxhash64("row", "i").alias("h")))
    fitted = F.coalesce("label", F.when((F.col("f")[_INSIDE] > 0) | (F.col("f")[_INSIDE + 1] > 0), 0.0))
    n = {r[0]: r[1] for r in each.filter(fitted.isNotNull()).groupBy(fitted.alias("label")).count().collect()}
    if len(n) < 2:
        return "0D", dict.fromkeys(GENERATORS, 2.0)
    fold = F.pmod("h", F.lit(5)) == 0
    place = F.pmod(F.shiftright("h", 8), F.lit(1 << 30)) / float(1 << 30)
    few = F.when(fitted == 1, place < sample / 1.6 / n[1.0]).otherwise(place < sample / 1.6 / n[0.0])
    names = [f"f{i}" for i in range(WIDTH)]
    train = cut(each.filter(~fold & fitted.isNotNull() & few).select(fitted.alias("label"), *(F.col("f")[i].alias(x) for i, x in enumerate(names))))
    if train.select("label").distinct().count() < 2:
        return "0D", dict.fromkeys(GENERATORS, 2.0)
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(train)
    model = GBTClassifier(maxIter=10, maxDepth=4, maxBins=32, stepSize=0.3, seed=1).fit(vectors.select("features", "label"))
    sql = model_sql(model, "c.f")
    bins = each.filter(fold).select("generator", F.struct("f").alias("c"), "label").select("generator", F.floor(F.expr(sql) * 100).cast("int").alias("p"), "label")
    one = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    bins = bins.groupBy("generator", "p").agg(one(F.col("label") == 1).alias("good"), one(F.col("label") == 0).alias("bad"), one(F.col("label").isNull()).alias("seen")).collect()
    out = {}
    for g in GENERATORS:
        # of the proposals seen in a bin as many as are expected are disguised data, the rest are not; half a negative
        # more in each bin, as a bin of few spans proves little
        scored = [(r.p, r.good * prior, max(0.0, r.seen - r.good * prior) + r.bad * prior + 0.5) for r in bins if r.generator == g]
        sure = [p for p, x in calibrated(scored) if x >= probability]
        out[g] = min(sure) / 100 if sure else 2.0
    return sql, out


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append ``base`` and ``spans``: the base spans, and these with the selected proposals, which overlap none.

    A selected number that overlaps a selected mailbox gives way. Every row is
    searched whole; null and empty texts have no spans; repeated rows give equal
    spans, whatever their ids; spans that begin together are in the kinds' order;
    an empty table gives no rows.
    """
    keep = [c for c in docs.columns if c not in ("base", "spans")]
    # user columns of the names used inside pass under others
    names = {c: f"__{i}__" for i, c in enumerate(keep) if c in ("proposals", "made", "__base__")}
    rows = propose(docs.select(*(F.col(f"`{c}`").alias(names.get(c, c)) for c in keep)), text)
    sql, least = learn(rows.select("proposals", "made"))
    chosen = lambda g: F.expr(f"filter(proposals, c -> c.generator = '{g}' AND {sql} >= {least[g]!r}D)")
    beside = lambda mail: F.concat(mail, F.when(F.size(mail) > 0, _apart(chosen("number"), mail)).otherwise(chosen("number")))
    free = _let(chosen("mailbox"), beside)
    more = F.transform(free, lambda c: F.struct(c["start"].alias("start"), F.lit(len(BASE)).alias("rank"), c["end"].alias("end"), F.lit("more").alias("kind")))
    out = rows.withColumn("spans", F.array_sort(F.concat("base", more)))
    return out.select(*(F.col(names.get(c, c)).alias(c) for c in keep), "base", "spans")
