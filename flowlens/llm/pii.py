"""PII spans: base patterns, high-recall generators and boosted trees, all in DataFrame functions.

Base spans follow fixed patterns and validators and are always reported.  Besides, looser
generators propose (overlapping) candidates: spelled-out or bracketed mail addresses,
bracketed network addresses, digit groups with other separators, numbers without a country
code.  A candidate becomes small integer features of its format and context, never the
validator's own result.

The trees learn from the candidates themselves.  One that overlaps a base span of its kind
counts as confirmed, and so does one in another form on evidence that the form does not
decide: with its separators put back to the plain ones the kind's validator accepts it.
Plain words (``at``, ``dot``) need a known top-level domain too, and a plain dot after ``at``
a cue in the context or the local part; numbers without ``+`` or ``00`` need a cue before
them or the same number as a base span of the document.  Spark counts the confirmed and all candidates of every distinct
feature pattern over the whole table; the ``PATTERNS`` most frequent ones of each kind (a
documented bound) are boosted with logistic loss on the driver.  Spark then scores the
counts of all patterns; the threshold of a form of a kind is the lowest edge of a score
bucket from which on ``PRECISION`` of all its candidates are confirmed.  Trees are applied as conditional expressions, inside the row that holds the
candidates: no Python on the executors and no shuffle of texts.

Each pattern reads a text once, in linear time: a start in the middle of a run of
characters is only tried right after a match, and loops that nothing can follow are
possessive.  Positions are code points.

Defined results: null and empty texts have no spans; equal rows get equal results; an
empty table gives no rows (and no trees); extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.session import materialize

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"

#: Base patterns; the same matches as the plain ones, written so that none retries a run of characters.
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

_AT, _DOT = r"\x20?(?:@|\(at\)|\[at\]|\{at\}|\x20at\x20)\x20?", r"\x20?(?:\.|\(dot\)|\[dot\]|\{dot\}|\x20dot\x20)\x20?"
#: Dots that do not end a sentence; tried before the others, so that an address ends where its sentence does.
_INNER_DOT = r"(?:\.|\x20\.\x20|\x20?(?:\(dot\)|\[dot\]|\{dot\}|\x20dot\x20)\x20?)"
_LABEL = "[A-Za-z0-9-]{2,63}"
GENERATORS = {
    "email": rf"(?i)(?:\G|(?<![{LOCAL}]))[{LOCAL}]{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}(?:(?:{_INNER_DOT}{_LABEL})+|(?:{_DOT}{_LABEL})+)",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20./_-]{0,2}[0-9]{3,7}){2,4}(?![0-9])",
    "phone": r"(?<![0-9])(?:(?:\+|00)[0-9]{0,3}[\x20-]?|[0-9]{1,3}[\x20-]?)?\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20./-]{1,2}[0-9]{3,5}(?![0-9])",
}
KEYWORDS = {
    1: r"(?i)(?:mail|contact|write|reach)[^A-Za-z]*$",
    2: r"(?i)(?:\bip|host|server|address|node|from)[^A-Za-z]*$",
    3: r"(?i)(?:card|visa|credit|paid|payment|account)[^A-Za-z]*$",
    4: r"(?i)(?:phone|tel|call|fax|mobile|cell)[^A-Za-z]*$",
}
CONTEXT = 24
#: Top-level domains that an address in plain words may end in.
TOP = (
    "com|net|org|edu|gov|mil|int|info|biz|name|pro|app|dev|xyz|online|site|shop|cloud|tech|example|test|a[c-gilmoq-uwxz]|"
    "b[abd-jm-or-tvwyz]|c[acdf-ik-oru-z]|d[ejkmoz]|e[cegr-u]|f[ijkmor]|g[abd-ilmnp-uwy]|h[kmnrtu]|i[delmnoq-t]|j[emop]|"
    "k[eghimnprwyz]|l[abcikr-vy]|m[acdeghk-z]|n[acefgilopruz]|om|p[ae-hk-nrstwy]|qa|r[eosuw]|s[a-eg-ortuvxyz]|"
    "t[cdfghj-ortvwz]|u[agksyz]|v[aceginu]|w[fs]|y[et]|z[amw]")
#: Forms of a candidate within its kind; the last feature.
FORMS = 4

PATTERNS = 4_000
TREES, DEPTH, RATE, LEAST_WEIGHT = 24, 3, 0.3, 5.0
PRECISION = 0.9
#: Score buckets: so many for one unit of the margin, numbered from -EDGE to EDGE.
STEPS, EDGE = 256, 1 << 15
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

SPAN = "struct<kind:int,start:int,end:int,m:string,before:string,after:string>"


def found(text: Column, pattern: str, kind: int, need: str | None) -> Column:
    """array<SPAN> of the leftmost non-overlapping matches, from the texts of and between the matches."""
    none = F.array().cast(f"array<{SPAN}>")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def step(acc: Column, i: Column) -> Column:
        piece, match = F.get(acc["q"], i), F.get(acc["m"], i)
        start = (acc["at"] + F.length(piece)).cast("int")
        end = (start + F.length(match)).cast("int")
        span = F.struct(
            F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), match.alias("m"),
            F.right(piece, F.lit(CONTEXT)).alias("before"), F.left(F.get(acc["q"], i + 1), F.lit(2)).alias("after"))
        return F.struct(end.alias("at"), acc["m"].alias("m"), acc["q"].alias("q"),
                        F.concat(acc["out"], F.array(span).cast(f"array<{SPAN}>")).alias("out"))

    first = F.struct(F.lit(0).alias("at"), matches.alias("m"), between.alias("q"), none.alias("out"))
    some = F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), first, step, lambda acc: acc["out"])
    tried = F.regexp_like(text, F.lit(pattern)) if need is None else F.contains(text, F.lit(need)) & F.regexp_like(text, F.lit(pattern))
    return F.when(tried, some).otherwise(none)


def valid(span: Column, kind: str) -> Column:
    """The base validator of a kind."""
    match = span["m"]
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    right = F.reverse(digits)
    total = F.lit(0)
    for k in range(1, 20):
        d = F.greatest(F.ascii(F.substring(right, k, 1)) - 48, F.lit(0))
        total = total + (F.when(d > 4, d * 2 - 9).otherwise(d * 2) if k % 2 == 0 else d)
    return F.length(digits).between(13, 19) & (total % 10 == 0)


def passes(kind: str):
    return lambda span: valid(span, kind)


def form(span: Column) -> Column:
    """0 for the base form of the kind, else which of its loose forms a candidate has."""
    match = span["m"]
    email = F.when(match.rlike(r"[(\[{]"), 1).when(match.rlike(r"(?i)\x20dot\x20"), 2).when(match.rlike(r"(?i)\x20at\x20"), 3).otherwise(0)
    ip = match.rlike(r"[(\[]").cast("int")
    card = match.rlike(r"[./_]|[\x20-]{2}").cast("int")
    phone = F.when(match.startswith("+"), F.when(match.contains("/"), 3).otherwise(0)).when(match.startswith("00"), 1).otherwise(2)
    return F.when(span["kind"] == 0, email).when(span["kind"] == 1, ip).when(span["kind"] == 2, card).otherwise(phone)


def evidence(span: Column, known: Column) -> Column:
    """Whether a candidate is one of its kind whatever its form; ``known`` are the digits of the document's base phone spans."""
    match, before = span["m"], span["before"]
    plain = match
    for pattern, sign in ((r"\x20?[(\[{]at[)\]}]\x20?|\x20{1,2}at\x20{1,2}|\x20@\x20", "@"),
                          (r"\x20?[(\[{]dot[)\]}]\x20?|\x20{1,2}dot\x20{1,2}|\x20\.\x20", ".")):
        plain = F.regexp_replace(plain, "(?i)" + pattern, sign)
    cue = before.rlike(KEYWORDS[1]) | plain.rlike("^[^@]*[0-9._%+-][^@]*@")
    email = plain.rlike(rf"^[{LOCAL}]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$") & (
        form(span).isin(0, 1) | plain.rlike(rf"(?i)\.(?:{TOP})$") & ((form(span) == 2) | cue))
    octets = F.regexp_replace(match, r"[\[(]\.[\])]", ".").rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    digits = F.regexp_replace(F.regexp_replace(match, "[^0-9]", ""), "^0+", "")
    phone = F.length(digits).between(9, 15) & (
        match.rlike(r"^(?:\+|00)") | before.rlike(KEYWORDS[4]) | F.exists(known, lambda d: d.endswith(digits)))
    return F.when(span["kind"] == 0, email).when(span["kind"] == 1, octets).when(
        span["kind"] == 2, valid(span, "card")).otherwise(phone)


def features(span: Column) -> Column:
    """array<int> of format and context."""
    match, before, after = span["m"], span["before"], span["after"]
    digits = F.regexp_count(match, F.lit("[0-9]"))
    groups = F.regexp_count(match, F.lit("[0-9]+"))
    word = F.lit(0)
    for code, pattern in KEYWORDS.items():
        word = F.when(before.rlike(pattern), code).otherwise(word)

    def edge(text: Column, pattern: str) -> Column:
        return F.when(F.length(text) == 0, 0).when(text.rlike(pattern % r"\s"), 1).when(text.rlike(pattern % r"\p{L}"), 2) \
            .when(text.rlike(pattern % "[0-9]"), 3).otherwise(4)

    return F.array(
        span["kind"], F.least(digits, F.lit(24)), F.least(F.length(match), F.lit(40)), F.least(groups, F.lit(8)),
        match.contains(" ").cast("int"), match.contains("-").cast("int"), match.contains(".").cast("int"),
        match.rlike(r"[()\[\]{}/_]").cast("int"),
        match.rlike(r"(?<![0-9])(?:25[6-9]|2[6-9][0-9]|[3-9][0-9]{2})(?![0-9])").cast("int"), match.rlike(r"^(?:\+|00)").cast("int"),
        F.when(match.contains("@"), 2).when(match.rlike(r"(?i)\bat\b"), 1).otherwise(0),
        edge(before, "%s$"), edge(after, "^%s"), word,
        F.least(F.length(F.regexp_extract(match, "[0-9]+", 0)), F.lit(8)),
        F.least(F.length(F.regexp_extract(match, "[0-9]+$", 0)), F.lit(8)), form(span))


def spans_of(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans in order of kind and start), found (candidates with features and confirmation)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("t"))
    rows = rows.select(
        "doc_id", *[found(F.col("t"), BASE[k], n, NEEDS[k]).alias(f"b_{k}") for n, k in enumerate(KINDS)],
        *[found(F.col("t"), GENERATORS[k], n, None).alias(f"g_{k}") for n, k in enumerate(KINDS)])
    short = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    rows = rows.select("doc_id", F.concat(*[
        F.transform(F.filter(f"b_{k}", passes(k)), short) for k in KINDS]).alias("base"),
        F.transform(F.filter("b_phone", passes("phone")), lambda s: F.regexp_replace(s["m"], "[^0-9]", "")).alias("known"),
        F.concat(*[F.col(f"g_{k}") for k in KINDS]).alias("g"))
    return rows.select("doc_id", "base", F.transform("g", lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), features(s).alias("f"),
        (F.exists("base", lambda b: (b["kind"] == s["kind"]) & overlap(b, s))
         | ~F.exists("base", lambda b: overlap(b, s)) & evidence(s, F.col("known"))).cast("int").alias("confirmed"),
        F.exists("base", lambda b: overlap(b, s)).alias("taken"))).alias("found"))


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def boost(rows: list[tuple[list[int], float, float]]) -> list[tuple]:
    """Trees of (features, confirmed, all) counts; a tree is a leaf value or (feature, limit, below, above)."""
    trees: list[tuple] = []
    margin = [0.0] * len(rows)

    def grow(at: list[int], depth: int):
        g = h = 0.0
        for i in at:
            g, h = g + grad[i], h + hess[i]
        leaf = -RATE * g / (h + 1.0)
        if depth == 0 or len(at) < 2:
            return leaf
        best = (1e-3, None)
        for f in range(len(rows[0][0])):
            bins: dict[int, list[float]] = {}
            for i in at:
                b = bins.setdefault(rows[i][0][f], [0.0, 0.0, 0.0])
                b[0] += grad[i]
                b[1] += hess[i]
                b[2] += rows[i][2]
            gl = hl = wl = 0.0
            total = sum(b[2] for b in bins.values())
            for value in sorted(bins)[:-1]:
                gl, hl, wl = gl + bins[value][0], hl + bins[value][1], wl + bins[value][2]
                if wl >= LEAST_WEIGHT and total - wl >= LEAST_WEIGHT:
                    gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                    if gain > best[0] + 1e-12:
                        best = (gain, (f, value))
        if best[1] is None:
            return leaf
        f, limit = best[1]
        return (f, limit, grow([i for i in at if rows[i][0][f] <= limit], depth - 1),
                grow([i for i in at if rows[i][0][f] > limit], depth - 1))

    for _ in range(TREES if rows else 0):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        grad = [q * n - y for q, (_, y, n) in zip(p, rows)]
        hess = [max(q * (1 - q), 1e-6) * n for q, (_, _, n) in zip(p, rows)]
        tree = grow(list(range(len(rows))), DEPTH)
        trees.append(tree)
        margin = [m + value(tree, x) for m, (x, _, _) in zip(margin, rows)]
    return trees


def value(tree, x: list[int]) -> float:
    while isinstance(tree, tuple):
        f, limit, below, above = tree
        tree = below if x[f] <= limit else above
    return tree


def margin_of(trees: list[tuple], f: Column) -> Column:
    """The trees as conditional expressions."""
    def walk(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        return F.when(F.get(f, F.lit(tree[0])) <= tree[1], walk(tree[2])).otherwise(walk(tree[3]))

    total = F.lit(0.0)
    for tree in trees:
        total = total + walk(tree)
    return total


def lowest(counts: dict[int, tuple[float, float]]) -> float:
    """The lowest edge of the score buckets {bucket: (confirmed, all)} from which on PRECISION are confirmed; infinite if none."""
    best, hits, total = math.inf, 0.0, 0.0
    for bucket in sorted(counts, reverse=True):
        hits, total = hits + counts[bucket][0], total + counts[bucket][1]
        if hits >= PRECISION * total and hits > 0:
            best = bucket / STEPS if bucket > -EDGE else -math.inf
    return best


def thresholds(rows: list[tuple[list[int], float, float]], trees: list[tuple]) -> list[float]:
    """Per kind, the lowest margin from which on PRECISION of the candidates are confirmed; infinite if none."""
    counts: list[dict] = [defaultdict(lambda: (0.0, 0.0)) for _ in KINDS]
    for x, y, n in rows:
        bucket = min(max(math.floor(sum(value(t, x) for t in trees) * STEPS), -EDGE), EDGE)
        hits, total = counts[x[0]][bucket]
        counts[x[0]][bucket] = (hits + y, total + n)
    return [lowest(c) for c in counts]


def group_of(f: Column) -> Column:
    """Number of the kind and form of a candidate."""
    return F.get(f, F.lit(0)) * FORMS + F.element_at(f, -1)


def calibrated(counts: DataFrame, trees: list[tuple]) -> list[float]:
    """Like ``thresholds``, per kind and form, from the counts (f, y, n) of every pattern, scored and summed in Spark."""
    bucket = F.least(F.greatest(F.floor(margin_of(trees, F.col("f")) * STEPS), F.lit(-EDGE)), F.lit(EDGE))
    rows = counts.groupBy(group_of(F.col("f")).alias("g"), bucket.alias("bucket")).agg(
        F.sum("y").alias("y"), F.sum("n").alias("n")).collect()
    return [lowest({r["bucket"]: (float(r["y"]), float(r["n"])) for r in rows if r["g"] == k}) for k in range(len(KINDS) * FORMS)]


def redactions(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end), by kind and start; spans holds base and the added ones."""
    rows = materialize(spans_of(docs), "pii-spans")
    counts = materialize(rows.select(F.explode("found").alias("c")).groupBy("c.f").agg(
        F.sum("c.confirmed").alias("y"), F.count(F.lit(1)).alias("n")), "pii-patterns")
    top = reduce(DataFrame.unionAll, [
        counts.filter(F.get("f", F.lit(0)) == k).orderBy(F.col("n").desc(), "f").limit(PATTERNS) for k in range(len(KINDS))])
    trees = boost(sorted((list(r["f"]), float(r["y"]), float(r["n"])) for r in top.collect()))
    limits = calibrated(counts, trees)

    def reaches(c: Column) -> Column:
        least = F.lit(math.inf)
        for group, x in enumerate(limits):
            if x < math.inf:
                least = F.when(group_of(c["f"]) == group, F.lit(x)).otherwise(least)
        return least

    scored = F.transform(F.filter("found", lambda c: ~c["taken"]), lambda c: F.struct(
        c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"),
        margin_of(trees, c["f"]).alias("score"), reaches(c).alias("least")))
    rows = rows.withColumn("s", F.filter(scored, lambda c: c["score"] >= c["least"]))
    better = lambda a, b: (a["score"] > b["score"]) | (
        (a["score"] == b["score"]) & (F.struct(a["start"], a["kind"], a["end"]) < F.struct(b["start"], b["kind"], b["end"])))
    added = F.filter("s", lambda c: ~F.exists("s", lambda o: overlap(o, c) & better(o, c)))
    short = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", F.transform(added, short))).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans."""
    rows = redactions(docs)
    count = lambda n: F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long")
    return rows.select("doc_id", *[count(n).alias(f"n_{k}") for n, k in enumerate(KINDS)],
                       F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mask: str = "[%s]") -> DataFrame:
    """The documents with every span replaced by its kind; spans that overlap become one mask.

    The spans are found from (id, text) rows and joined back by both, so rows that repeat
    an id with other texts keep their own.
    """
    key = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(
        "row", F.xxhash64("row.doc_id", "row.text").alias("key"))
    texts = key.select(F.col("key").alias("doc_id"), "row.text").dropDuplicates(["doc_id"])
    rows = key.join(redactions(texts).select(F.col("doc_id").alias("key"), "spans"), "key")
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    names = F.array(*[F.lit(mask % k) for k in KINDS])
    text = F.col("row.text")
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        new = F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], gap, F.element_at(names, s["kind"] + 1)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), new.alias("out"))

    rest = F.aggregate(ordered, first, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    masked = F.when(text.isNotNull(), rest)
    return rows.select(*[masked.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
