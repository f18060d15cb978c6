"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control.

DataFrame functions only. Texts are read once; what is kept of them (spans and test results) is
written to the checkpoint folder, counted per stratum, and read again with the thresholds.

Positions come without a position function: the pieces between the matches (``split``) and the matches
(``regexp_extract_all``) alternate, so their lengths add up to every start.

The method. Candidates are runs of 16 and more encoding characters. The
encoding is the narrowest alphabet that holds all characters: hex, base 32, base 36, base 64. Under
"drawn uniformly from that alphabet" these tests give a p-value each: chi-squared of the character counts
(upper tail, Wilson-Hilferty) and of three classes of characters (digits, letters common in words, others),
which tells words in short strings; Wald-Wolfowitz runs above and below the middle of the alphabet; and
the lag-one serial correlation (both two-sided). They are combined by the Cauchy rule. Text-like
candidates have values near 0; random ones are uniform, so twice the candidates above one half
estimate how many are random (Storey). Per encoding and length class the smallest threshold is
taken at which the share of others among those above it is at most ``FALSE_SHARE``; short strings, where
the tests tell less, thereby get higher thresholds. Each class's counts are joined with the same small
weight of its encoding's, so that no threshold rests on a handful of candidates.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeframe.llm.common import checkpointed, read_table
from gradeframe.operators.staging import evaluate_once

# Fixed values of the scan's contract, in the order of the kinds. The look-ahead only skips faster.
ASSIGN = (r"(?i:(?=[psta])(password|passwd|secret|token|api_?key))"
          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{14,}"  # runs of 18 and more
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGNED = 12

LEAST_TESTED = 16  # characters of a candidate, as of the shortest base kind
# A run of encoding characters. One that ends with the name of an assignment belongs to that; of the
# assignments only their lengths count here, so they come first and are left out.
ASSIGNED = ASSIGN.replace("+)", f"{{{LEAST_ASSIGNED},}})")
CANDIDATE = (rf"(?<![A-Za-z0-9+/_-])(?![A-Za-z0-9+/_-]*?{ASSIGNED.replace('([A', '(?:[A').replace('(password', '(?:password')})"
             rf"([A-Za-z0-9+/_-]{{{LEAST_TESTED},}}+={{0,2}})")
CHUNK, LEVELS = 16, 3  # of sums over matches
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# Name, test of the characters, alphabet; the narrowest first.
ENCODINGS = (
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef"),
    ("base32", r"^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", r"^[a-z0-9]+$", DIGITS + LOWER),
    ("base64", r"^[A-Za-z0-9+/_-]+$", UPPER + LOWER + DIGITS + "+/"),
)
COMMON = "aeinorstAEINORST"
FALSE_SHARE, BINS, PRIOR = 0.05, 100, 20.0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once; a lambda computes what it does not bind at every call."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, start: Column, levels: int = LEVELS) -> Column:
    """Before each value: ``start`` and the sum of all values before it.

    A fold that appends copies its list at every step, so values go in chunks, whose sums go in chunks
    again: the work grows with the number of values, not with its square.
    """
    if not levels:
        return F.aggregate(
            values, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, v: F.struct((acc.at + v).alias("at"), F.concat(acc.out, F.array(acc.at)).alias("out")),
            lambda acc: acc.out)

    def in_chunks(every: Column) -> Column:
        last = F.greatest(F.ceil(F.size(every) / F.lit(CHUNK)).cast("int") - 1, F.lit(0))
        chunks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(every, i * CHUNK + 1, F.lit(CHUNK)))
        sums = lambda c: F.transform(c, lambda chunk: F.aggregate(chunk, F.lit(0), lambda x, y: x + y))
        return let(chunks, lambda c: F.flatten(F.zip_with(
            c, running(sums(c), start, levels - 1), lambda chunk, at: running(chunk, at, 0))))

    return let(values, in_chunks)


def spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """start, kind, end and text of the leftmost matches that do not overlap, whose ``group`` has ``least`` characters."""
    lengths = lambda array: F.transform(array, lambda x: F.length(x))
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
                     lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).alias("part"),
                     lengths(F.split(text, pattern, -1)).alias("gap"))

    def placed(m: Column) -> Column:
        steps = F.zip_with(m.gap, m.whole, lambda gap, whole: gap + F.coalesce(F.length(whole), F.lit(0)))
        each = F.arrays_zip(running(steps, F.lit(0)).alias("at"), m.gap.alias("gap"), m.whole.alias("whole"), m.part.alias("part"))
        return F.transform(F.filter(each, lambda x: x.part >= least), lambda x: F.struct(
            (x["at"] + x.gap).alias("start"), F.lit(kind).alias("kind"),
            (x["at"] + x.gap + F.length(x.whole)).alias("end"), x.whole.alias("text")))

    none = F.array().cast("array<struct<start: int, kind: int, end: int, text: string>>")
    return F.when(text.rlike(pattern), let(found, placed)).otherwise(none)


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution (Abramowitz and Stegun 7.1.26, error below 2e-7)."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1 / (1 + 0.3275911 * x)
    half = 0.5 * F.exp(-x * x) * t * (0.254829592 + t * (-0.284496736 + t * (
        1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.when(z >= 0, half).otherwise(1 - half)


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def battery(candidates: Column) -> Column:
    """start, end, encoding, n and the combined p-value of every candidate (start, end, text).

    A step per transform, so that what later steps use several times is computed once.
    """
    def encoded(c):
        core = F.translate(F.rtrim(c.text, F.lit("=")), "-_", "+/")
        number = F.coalesce(*[F.when(core.rlike(p), i) for i, (_, p, _) in enumerate(ENCODINGS)], F.lit(len(ENCODINGS) - 1))
        both = c.text.rlike("[0-9]") & c.text.rlike("[A-Za-z]")
        return F.struct(c.start.alias("start"), c.end.alias("end"), number.alias("encoding"), both.alias("both"),
                        F.when(number == 0, F.lower(core)).otherwise(core).alias("text"))

    def valued(c):
        alphabet = F.element_at(F.array(*[F.lit(a) for _, _, a in ENCODINGS]), c.encoding + 1)
        values = F.transform(F.split(c.text, ""), lambda x: F.instr(alphabet, x).cast("double") - 1)
        n = F.length(c.text).cast("double")
        share = lambda chars: F.element_at(F.array(*[
            F.lit(sum(x in chars for x in a) / len(a)) for _, _, a in ENCODINGS]), c.encoding + 1)
        seen = [(share(x), F.length(F.regexp_replace(c.text, f"[^{x}]", ""))) for x in (DIGITS, COMMON)]
        seen.append((1 - seen[0][0] - seen[1][0], n - seen[0][1] - seen[1][1]))
        classes = sum(((count - n * part) * (count - n * part) / (n * part) for part, count in seen), F.lit(0.0))
        return F.struct(c.start, c.end, c.encoding, c.both, F.length(alphabet).cast("double").alias("k"), n.alias("n"),
                        classes.alias("classes"), values.alias("v"))

    def summed(c):
        squares = total(F.transform(F.array_distinct(c.v), lambda x: F.pow(
            F.size(F.filter(c.v, lambda y: y == x)).cast("double"), F.lit(2.0))))
        above = F.transform(c.v, lambda x: F.when(x >= c.k / 2, 1.0).otherwise(0.0))
        return F.struct(c.start, c.end, c.encoding, c.both, c.k, c.n, c.classes, c.v, squares.alias("squares"), above.alias("above"),
                        total(above).alias("high"), (total(c.v) / c.n).alias("mean"))

    def paired(c):
        count = c.n.cast("int")
        ahead = lambda array: F.slice(array, F.lit(2), count)
        changes = total(F.zip_with(F.slice(c.above, F.lit(1), count - 1), ahead(c.above), lambda a, b: F.abs(a - b)))
        product = total(F.zip_with(F.slice(c.v, F.lit(1), count - 1), ahead(c.v), lambda a, b: (a - c.mean) * (b - c.mean)))
        spread = total(F.transform(c.v, lambda x: (x - c.mean) * (x - c.mean)))
        return F.struct(c.start, c.end, c.encoding, c.both, c.k, c.n, c.classes, c.squares, c.high, changes.alias("changes"),
                        (product / F.greatest(spread, F.lit(1e-9))).alias("r"))

    def scored(c):
        df = c.k - 1
        chi = c.k / c.n * c.squares - c.n
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        low = c.n - c.high
        mean = 2 * c.high * low / c.n + 1
        variance = (mean - 1) * (mean - 2) / (c.n - 1)
        z_runs = F.when(variance > 0, (c.changes + 1 - mean) / F.sqrt(variance)).otherwise(F.lit(9.0))
        z_serial = (c.r + 1 / (c.n - 1)) * F.sqrt(c.n)
        return F.struct(c.start, c.end, c.encoding, c.both, c.n, F.exp(-c.classes / 2).alias("classes"), z_chi.alias("chi"), F.abs(z_runs).alias("runs"),
                        F.abs(z_serial).alias("serial"))

    def combined(c):
        inside = lambda p: F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
        values = (inside(c.classes), inside(upper_tail(c.chi)), inside(2 * upper_tail(c.runs)), inside(2 * upper_tail(c.serial)))
        cauchy = sum((F.tan((0.5 - p) * F.lit(3.141592653589793)) for p in values), F.lit(0.0)) / len(values)
        return F.struct(c.start, c.end, c.encoding, c.both, c.n.cast("int").alias("n"),
                        (0.5 - F.atan(cauchy) / F.lit(3.141592653589793)).alias("p"))

    for step in (encoded, valued, summed, paired, scored, combined):
        candidates = F.transform(candidates, step)
    return candidates


def length_class(n: Column) -> Column:
    """Two classes for each doubling of the length."""
    return F.floor(2 * F.log2(n)).cast("int")


def thresholds(counts: list) -> dict[tuple[int, int, bool], float]:
    """The p-value a candidate needs, per (encoding, length class, both), from rows (encoding, size, both, bin, n).

    ``both`` tells whether a candidate has a letter and a digit. Those without are nearly all words, which short tests
    cannot tell from chance; how many of them are random follows from the others: as many as uniform strings
    of that length lack the one or the other.
    """
    own, pooled = defaultdict(lambda: [0] * BINS), defaultdict(lambda: [0] * BINS)
    for row in counts:
        own[row.encoding, row.size, row.both][row.bin] += row.n
        pooled[row.encoding, row.both][row.bin] += row.n
    chosen = {}
    for (encoding, size, both), bins in own.items():
        # A class counts with as many of its encoding's counts as PRIOR says, however large it is.
        share = PRIOR / sum(pooled[encoding, both])
        bins = [n + share * m for n, m in zip(bins, pooled[encoding, both])]
        random = 2 * sum(bins[BINS // 2:])
        if not both:
            alphabet = ENCODINGS[encoding][2]
            digits, length = sum(x in DIGITS for x in alphabet) / len(alphabet), 2 ** (size / 2)
            lacking = (1 - digits) ** length + digits ** length
            others = own.get((encoding, size, True), [0])
            random = 2 * sum(others[BINS // 2:]) * lacking / (1 - lacking)
        chosen[encoding, size, both] = 2.0  # beyond every p-value: none
        for at in range(1, BINS):
            above = sum(bins[at:])
            if above > 0 and 1 - random * (1 - at / BINS) / above <= FALSE_SHARE:
                chosen[encoding, size, both] = at / BINS
                break
    return chosen


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Whole texts; null is empty. Spans are ``kind:start:end`` in code points, end exclusive, by start and
    then in the order of KINDS. Every base span stays; a random string that overlaps none of them is
    added as kind ``random``. Repeated rows give repeated rows; other columns are ignored; an empty
    table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    # Behind a generator, so that filters and counts above do not scan the text again.
    scanned = evaluate_once(
        docs.select("doc_id", text.alias("text")), drop=("text",),
        assign=spans(F.col("text"), ASSIGN, 0, 2, LEAST_ASSIGNED), access=spans(F.col("text"), ACCESS, 1),
        hex=spans(F.col("text"), HEX, 2),
        candidates=spans(F.col("text"), f"{ASSIGNED}|{CANDIDATE}", 3, 3, LEAST_TESTED),
    )
    plain = lambda kind: F.transform(kind, lambda s: F.struct(s.start, s.kind, s.end))
    base = F.array_sort(F.concat(*map(plain, KINDS[:3])))
    # A run of encoding characters holds every access and hex match that touches it.
    fresh = F.filter("candidates", lambda c: ~c.text.rlike(ACCESS) & ~c.text.rlike(HEX))
    tested = checkpointed(
        scanned.withColumn("base", base)
        .select("doc_id", "base", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]],
                battery(fresh).alias("tested")))
    # At most encodings x length classes x 2 x bins rows.
    counts = (
        tested.select(F.explode("tested").alias("c"))
        .select("c.encoding", length_class(F.col("c.n")).alias("size"), "c.both",
                F.least(F.floor(F.col("c.p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
        .groupBy("encoding", "size", "both", "bin").agg(F.count(F.lit(1)).alias("n")).collect())
    needed = F.create_map(*[F.lit(x) for (encoding, size, both), p in sorted(thresholds(counts).items())
                            for x in (f"{encoding}/{size}/{str(both).lower()}", p)]) if counts else F.create_map(F.lit(""), F.lit(2.0))
    random = F.transform(
        F.filter("tested", lambda c: c.p >= F.coalesce(
            F.try_element_at(needed, F.concat_ws("/", c.encoding, length_class(c.n), c.both)), F.lit(2.0))),
        lambda c: F.struct(c.start.alias("start"), F.lit(3).alias("kind"), c.end.alias("end")))
    kind = F.array(*map(F.lit, KINDS))
    joined = lambda array: F.array_join(F.transform(array, lambda s: F.concat_ws(
        ":", F.element_at(kind, s.kind + 1), s.start, s.end)), ",")
    return tested.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined("base"), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", random))).alias("spans"))


def op2_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return scan_secrets(read_table(spark, folder, "documents"))
