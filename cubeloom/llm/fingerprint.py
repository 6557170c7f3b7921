"""Document fingerprints by a homomorphic multiset hash, in DataFrame expressions only.

A text is the multiset of its passages (sentences of paragraphs). Every passage is
hashed to a wide vector: 256 lanes of one bit and four lanes of 32 bits, from six hashes
of the passage itself under different seeds. A
fingerprint is the number of passages and the sum of their vectors, bit lanes modulo
2^12 and wide lanes modulo 2^32. So it does not depend on the order of passages, and
that of an edited text follows by adding and subtracting passages (add, subtract).
Bit lanes are kept as bit planes: plane p holds bit p of 64 counters, and a vector is
added to all of them with a carry chain of AND and XOR.

Likeness comes from two fingerprints alone. With bits read as signs, a lane's
difference has as its mean square the size of the symmetric difference of the two
multisets, so 1 - |A - B| / (|A| + |B|) is estimated over 256 lanes. Equal multisets
give 1.

The text after a document, in ascending doc_id order, is found in ranges of about RANGE
rows, each sorted in one task: ids are cut at COARSE - 1 quantiles and evenly between
two of them, so ranges follow the rows however ids are spread. The first of the next
range that has documents joins its predecessors there.

Defined cases: null text is empty and has no passages; two empty texts have likeness
1. Rows with a null doc_id have no next document: their edited text lacks the part
that it would bring, and near_next compares with the empty text. Rows that repeat a
doc_id are ordered by their text's hash. Further columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.runtime import written

WORDS, PLANES, WIDE = 4, 12, 4
GROUP, SHORT = 63, 6
RANGE, COARSE, BROADCAST_RANGES = 256, 128, 1 << 20
PASSAGE = r"(?<=[.!?])\\s+|\\n+"
_MASK = "4294967295L"


def passages(text: str) -> str:
    """SQL for the passages of a text column; white space alone is none."""
    return f"filter(split({text}, '{PASSAGE}'), u -> length(trim(u)) > 0)"


def _added(a: str, b: str, borrow: bool = False) -> str:
    """SQL for bit planes a + b (a - b with borrow) modulo 2^PLANES; a and b are SQL
    for plane p, given as functions of the lambda variable p (from 1)."""
    carry = f"(~({a}) & ({b})) | (~(({a}) ^ ({b})) & s.c)" if borrow else f"(({a}) & ({b})) | ((({a}) ^ ({b})) & s.c)"
    return f"aggregate(sequence(1, {PLANES}), struct(0L as c, cast(array() as array<bigint>) as o), (s, p) -> struct({carry} as c, concat(s.o, array(({a}) ^ ({b}) ^ s.c)) as o), s -> s.o)"


def fingerprint(text: str) -> Column:
    """struct(n, wide: array of WIDE longs, planes: array of WORDS * PLANES longs).

    Passages are counted GROUP at a time into SHORT planes, groups are then added up:
    most steps need short carry chains only."""
    zero, step = ["0L as n"], ["acc.n + 1L as n"]
    for k in range(WIDE // 2):
        h = f"u[{WORDS + k}]"
        for name, part in ((f"w{2 * k}", h), (f"w{2 * k + 1}", f"shiftrightunsigned({h}, 32)")):
            zero.append(f"0L as {name}")
            step.append(f"(acc.{name} + ({part} & {_MASK})) & {_MASK} as {name}")
    for k in range(WORDS):
        carry = f"u[{k}]"
        for q in range(SHORT):
            name = f"p{k}_{q}"
            zero.append(f"0L as {name}")
            step.append(f"acc.{name} ^ ({carry}) as {name}")
            carry = f"acc.{name} & {carry}"
    wide = ", ".join(f"acc.w{k}" for k in range(WIDE))
    planes = ", ".join(f"acc.p{k}_{q}" for k in range(WORDS) for q in range(SHORT))
    done = f"acc -> struct(acc.n as n, array({wide}) as wide, array({planes}) as planes)"
    group = f"aggregate(slice(h, g * {GROUP} + 1, {GROUP}), struct({', '.join(zero)}), (acc, u) -> struct({', '.join(step)}), {done})"
    groups = f"transform(filter(sequence(0, size(h) div {GROUP}), g -> g * {GROUP} < size(h)), g -> {group})"
    planes = _added(f"element_at(acc.planes, k * {PLANES} + p)", f"if(p <= {SHORT}, element_at(x.planes, k * {SHORT} + if(p <= {SHORT}, p, 1)), 0L)")
    total = f"flatten(transform(sequence(0, {WORDS - 1}), k -> {planes}))"
    none = f"struct(0L as n, array_repeat(0L, {WIDE}) as wide, array_repeat(0L, {WORDS * PLANES}) as planes)"
    first = f"struct(x.n as n, x.wide as wide, flatten(transform(sequence(0, {WORDS - 1}), k -> concat(slice(x.planes, k * {SHORT} + 1, {SHORT}), array_repeat(0L, {PLANES - SHORT})))) as planes)"
    both = f"struct(acc.n + x.n as n, zip_with(acc.wide, x.wide, (v, w) -> (v + w) & {_MASK}) as wide, {total} as planes)"
    hashes = ", ".join(f"xxhash64({k}, u)" for k in range(WORDS + WIDE // 2))
    return F.expr(f"transform(array(transform({passages(text)}, u -> array({hashes}))), h -> aggregate({groups}, {none}, (acc, x) -> if(acc.n = 0, {first}, {both})))[0]")


def as_text(fp: str) -> Column:
    """The fingerprint in hexadecimal: n, wide lanes, planes."""
    return F.expr(f"lower(concat(hex({fp}.n), '-', array_join(transform({fp}.wide, x -> lpad(hex(x), 8, '0')), ''), '-', array_join(transform({fp}.planes, x -> lpad(hex(x), 16, '0')), '')))")


def likeness(a: str, b: str) -> Column:
    """Estimated 1 - |A - B| / (|A| + |B|) of two fingerprints, from 0 to 1: the mean
    square of the lanes' differences, from the population counts of plane pairs."""
    difference = _added(f"element_at({a}.planes, k * {PLANES} + p)", f"element_at({b}.planes, k * {PLANES} + p)", borrow=True)
    # bits as signs: twice the difference less the difference in number
    signed = _added("if(p = 1, 0L, element_at(d, if(p = 1, 1, p - 1)))", f"-(shiftright({a}.n - {b}.n, p - 1) & 1L)", borrow=True)
    weight = [1 << q for q in range(PLANES - 1)] + [-(1 << (PLANES - 1))]
    terms = " + ".join(
        f"{weight[q] * weight[r] * (1 if q == r else 2)}L * bit_count({f'element_at(e, {q + 1})' if q == r else f'element_at(e, {q + 1}) & element_at(e, {r + 1})'})" for q in range(PLANES) for r in range(q, PLANES)
    )
    square = f"aggregate(sequence(0, {WORDS - 1}), 0L, (t, k) -> t + transform(array({difference}), d -> transform(array({signed}), e -> {terms})[0])[0])"
    both = f"({a}.n + {b}.n)"
    return F.expr(f"case when {both} = 0 then 1.0D else greatest(0.0D, least(1.0D, 1.0D - {square} / {float(64 * WORDS)}D / {both})) end")


def _planewise(a: str, b: str, borrow: bool) -> Column:
    sign = "-" if borrow else "+"
    planes = _added(f"element_at({a}.planes, k * {PLANES} + p)", f"element_at({b}.planes, k * {PLANES} + p)", borrow)
    return F.expr(f"struct({a}.n {sign} {b}.n as n, zip_with({a}.wide, {b}.wide, (x, y) -> (x {sign} y) & {_MASK}) as wide, flatten(transform(sequence(0, {WORDS - 1}), k -> {planes})) as planes)")


def add(a: str, b: str) -> Column:
    """Fingerprint of two texts' passages together (insertion)."""
    return _planewise(a, b, False)


def subtract(a: str, b: str) -> Column:
    """Fingerprint of a without the passages of b (deletion)."""
    return _planewise(a, b, True)


def _ranges(docs: DataFrame) -> tuple[Column, list]:
    """(the range of a doc_id, ascending with it; what comes first after each of the
    coarse parts): tables of at most COARSE rows come to the driver."""
    marks = docs.agg(F.percentile_approx("doc_id", [k / COARSE for k in range(1, COARSE)], 10_000)).first()[0]
    marks = sorted(set(marks or []))
    part = F.expr(f"size(filter(array({', '.join(f'{m}L' for m in marks)}), x -> x <= doc_id))") if marks else F.lit(0)
    rows = docs.groupBy(part.alias("part")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"), F.min(F.struct("doc_id", "tie")).alias("first")).collect()
    low, width, after = [0.0] * (len(marks) + 1), [1.0] * (len(marks) + 1), [None] * (len(marks) + 1)
    for r in rows:
        low[r.part], width[r.part] = float(r.low), max(1.0, (r.high - r.low + 1) / max(1, r.n // RANGE))
    order = sorted(rows, key=lambda r: r.part)
    for k, r in enumerate(order):
        after[r.part] = tuple(order[(k + 1) % len(order)].first)
    arrays = [F.array(*[F.lit(float(x)) for x in xs]) for xs in (low, width)]
    inside = F.floor((F.col("doc_id").cast("double") - F.get(arrays[0], part)) / F.get(arrays[1], part)).cast("long")
    return (part.cast("long") * (1 << 44) + inside), after


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs (doc_id not null, tie, columns) with struct `next` of those columns of
    the next row by (doc_id, tie); after the last row comes the first.

    The first row of every range goes to the range before it as well, so texts are
    shuffled once. Which rows those are is a table of one row a range: broadcast up to
    BROADCAST_RANGES rows, joined by a shuffle beyond."""
    ids = docs.select("doc_id", "tie")
    at, after = _ranges(ids)
    first = ids.groupBy(at.alias("range")).agg(F.min(F.struct("doc_id", "tie")).alias("first")).withColumn("part", F.shiftright("range", 44))
    last = F.get(F.array(*[F.struct(F.lit(a[0]).cast("long").alias("doc_id"), F.lit(a[1]).cast("long").alias("tie")) for a in (x or (None, None) for x in after)]), F.col("part").cast("int"))
    nexts = first.select("range", F.coalesce(F.expr("lead(first) over (partition by part order by range)"), last).alias("f"))
    heads = written(nexts.select(F.col("range").alias("before"), F.col("f.doc_id").alias("doc_id"), F.col("f.tie").alias("tie")), "heads")
    heads = F.broadcast(heads) if heads.count() <= BROADCAST_RANGES else heads
    sent = docs.withColumn("range", at).join(heads, ["doc_id", "tie"], "left")
    sent = sent.select(*docs.columns, F.explode(F.expr("if(before is null, array(struct(range, 0 as guest)), array(struct(range, 0 as guest), struct(before as range, 1 as guest)))")).alias("at"))
    sent = sent.select(*docs.columns, "at.range", "at.guest")
    found = sent.withColumn("next", F.expr(f"lead(struct({', '.join(columns)})) over (partition by range order by guest, doc_id, tie)"))
    return found.where("guest = 0").select(*docs.columns, "next")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next: each text beside one whose last half comes from the next document."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("tie", F.xxhash64("text"))
    marked = base.where("doc_id is not null").withColumn("fp", fingerprint("text"))
    lonely = base.where("doc_id is null").withColumn("fp", fingerprint("text")).withColumn("next", F.struct(F.lit("").alias("text"), fingerprint("''").alias("fp")))
    paired = with_next(marked, ["text", "fp"]).unionByName(lonely)
    paired = paired.withColumn("n_chars", F.length("text").cast("long")).withColumn("cut", F.expr("cast(n_chars div 2 as int)"))
    edited = paired.withColumn("edited", F.expr("concat(left(text, cast(n_chars as int) - cut), left(next.text, cut))")).withColumn("efp", fingerprint("edited"))
    return edited.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text("fp").alias("fingerprint"), as_text("efp").alias("edited_fingerprint"),
        likeness("fp", "efp").alias("near_edited"), likeness("fp", "next.fp").alias("near_next"),
    )
