"""Secrets in texts: three named patterns, and strings that pass a battery of randomness tests. DataFrame functions only.

1. Patterns. Matches are leftmost and do not overlap; their places come from the lengths of the text between them (code
   points, end exclusive). A span is the whole match.
2. Candidates are maximal runs of 16 or more letters, digits and ``+/_-`` (and up to two ``=`` behind). The smallest alphabet that
   holds a run is its inferred encoding.
3. Battery, under the hypothesis that the symbols are drawn evenly and independently from that alphabet: chi-squared of the
   symbols; chi-squared of the classes digit, capital, small letter, other; runs above and below the middle of the alphabet
   (Wald-Wolfowitz); serial correlation of neighbours. The tests depend on each other, so their p-values are combined
   by the Cauchy rule, which holds then too.
4. Length-aware control. Short strings have no power against the hypothesis: below ``BITS`` bits (length times bits a symbol)
   none is called. The others are divided by encoding and length class, and in each stratum the Benjamini-Hochberg rule at
   ``RATE`` says which are not random, so that of the strings given up as not random at most that share is expected to be. What is left is called.
   p-values are rounded up to a grid of ``GRID`` steps an octave, which keeps them valid and makes the rule a table of
   counts: strata times grid steps, whatever the corpus holds. Copies of a string count once.

The base spans stay as they are; a called string that overlaps one of them is not repeated. Null and empty texts have no
spans. Rows are independent but for the thresholds, which do not depend on copies; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritylab.llm.common import cut_lineage

#: Kinds of base spans in the order of the report: pattern, group that must be long, its least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = [("assign", ASSIGN, 2, 8), ("access", r"AKIA[A-Z0-9]++", 0, 16), ("hex", r"(?<![0-9a-f])[0-9a-f]{32,}+", 0, 32)]
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}"
RANDOM = "random"

DIGITS, SMALL, CAPITAL = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings, the smallest alphabet first.
ENCODINGS = [("decimal", DIGITS), ("hex", DIGITS + "abcdef"), ("HEX", DIGITS + "ABCDEF"), ("base32", CAPITAL + "234567"), ("base36", DIGITS + SMALL),
             ("BASE36", DIGITS + CAPITAL), ("base62", DIGITS + CAPITAL + SMALL), ("base64", CAPITAL + SMALL + DIGITS + "+/"),
             ("base64url", CAPITAL + SMALL + DIGITS + "-_")]
CLASSES = [f"[{x}]" for x in ("0-9", "A-Z", "a-z", "+/_-")]
BITS, RATE, GRID, LEAST_OCTAVE = 96, 0.05, 8, 20
#: Upper ends of the length classes.
LENGTHS = (20, 24, 32, 40, 64, 128, 512)
BLOCK = 256


def _running(values: Column) -> Column:
    """0, then the running sums of a short array."""
    return F.aggregate(values, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def with_spans(df: DataFrame, kinds: list[tuple[str, str]], text: str) -> DataFrame:
    """``df`` without ``text`` and with, for each (column, pattern), the matches as an array of (found, start, end).

    Appending to an array copies it, so running sums are taken in blocks and over the blocks' totals."""
    names = [c for c, _ in kinds]
    df = df.select("*", *[F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(c) for c, p in kinds])
    df = df.select("*", *[F.when(F.size(c) > 0, F.transform(F.split(text, p, -1), F.length)).alias(f"_gap_{c}") for c, p in kinds]).drop(text)
    df = df.select("*", *[F.when(F.size(c) > 0, _steps(c)).alias(f"_step_{c}") for c in names])
    df = df.select("*", *[_block_sums(c).alias(f"_in_{c}") for c in names])
    df = df.select("*", *[_running(F.transform(f"_in_{c}", lambda x: F.element_at(x, -1))).alias(f"_off_{c}") for c in names])
    df = df.select("*", *[_starts(c).alias(f"_at_{c}") for c in names])
    none = F.array().cast("array<struct<found: string, start: bigint, end: bigint>>")
    made = [F.when(F.size(c) > 0, _places(c)).otherwise(none).alias(c) for c in names]
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names and not c.startswith(("_gap_", "_step_", "_in_", "_off_", "_at_"))], *made)


def _steps(c: str) -> Column:
    """Length of each match and of the text before it."""
    return F.zip_with(F.slice(f"_gap_{c}", 1, F.size(c)), c, lambda gap, found: (gap + F.length(found)).cast("long"))


def _block_sums(c: str) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / BLOCK).cast("int")),
                       lambda b: _running(F.slice(F.col(f"_step_{c}"), b * BLOCK + 1, F.lit(BLOCK))))


def _starts(c: str) -> Column:
    return F.flatten(F.transform(f"_in_{c}", lambda sums, b: F.transform(F.slice(sums, 1, F.size(sums) - 1), lambda y: y + F.col(f"_off_{c}")[b])))


def _places(c: str) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(c) - 1), lambda i: _span(F.col(c)[i], F.col(f"_at_{c}")[i] + F.col(f"_gap_{c}")[i]))


def _span(found: Column, start: Column) -> Column:
    return F.struct(found.alias("found"), start.alias("start"), (start + F.length(found)).alias("end"))


def _literal(values) -> str:
    return "array(" + ", ".join(f"'{v}'" if isinstance(v, str) else repr(v) for v in values) + ")"


def _upper_tail(z: str) -> str:
    """SQL of the normal upper tail at a number of 0 or more: Abramowitz and Stegun 26.2.17, error below 1e-7."""
    t = f"(1 / (1 + 0.2316419D * ({z})))"
    # Fixed values of the formula.
    poly = f"{t} * (0.319381530D + {t} * (-0.356563782D + {t} * (1.781477937D + {t} * (-1.821255978D + {t} * 1.330274429D))))"
    return f"greatest(exp(-({z}) * ({z}) / 2) / {math.sqrt(2 * math.pi)!r}D * {poly}, 1e-9D)"


def _chi_tail(x: str, df: str) -> str:
    """SQL of the chi-squared upper tail (Wilson-Hilferty)."""
    z = f"((pow(({x}) / ({df}), 1D / 3) - (1 - 2D / (9 * ({df})))) / sqrt(2D / (9 * ({df}))))"
    return f"(CASE WHEN {z} >= 0 THEN {_upper_tail(z)} ELSE 1 - {_upper_tail(f'-({z})')} END)"


def tested(df: DataFrame, column: str) -> DataFrame:
    """``column``, an array of (found, start, end), becomes one of (start, end, encoding, size, octaves, digest): the candidates
    with an encoding and enough bits, the size class, the combined p-value as steps of the grid (rounded up) and a hash of the string.

    Every test is one pass over the symbols, so a long string costs its length."""
    def put(df, expression):
        return df.select(*[F.col(f"`{c}`") for c in df.columns if c != column], F.expr(expression).alias(column))

    symbols, count = _literal([a for _, a in ENCODINGS]), _literal([len(a) for _, a in ENCODINGS])
    kind = "CASE " + " ".join(f"WHEN x.s RLIKE '^[{a.replace('-', '') + '-' * ('-' in a)}]+$' THEN {i}" for i, (_, a) in enumerate(ENCODINGS)) + " END"
    shares = "array(" + ", ".join(_literal([sum(ch in chars for ch in a) for chars in (DIGITS, CAPITAL, SMALL, "+/_-")]) for _, a in ENCODINGS) + ")"
    least = _literal([math.ceil(BITS / math.log2(len(a))) for _, a in ENCODINGS])
    df = put(df, f"transform({column}, x -> named_struct('start', x.start, 'end', x.end, 's', rtrim('=', x.found)))")
    df = put(df, f"transform({column}, x -> named_struct('start', x.start, 'end', x.end, 's', x.s, 'n', length(x.s), 'e', {kind}))")
    df = put(df, f"filter({column}, x -> x.e IS NOT NULL AND x.n >= {least}[x.e])")
    df = put(df, f"""transform({column}, x -> named_struct('start', x.start, 'end', x.end, 's', x.s, 'n', CAST(x.n AS DOUBLE), 'e', x.e,
        'k', CAST({count}[x.e] AS DOUBLE), 'v', transform(split(x.s, ''), c -> instr({symbols}[x.e], c) - 1),
        'squares', aggregate(split({symbols}[x.e], ''), 0D, (t, c) -> t + pow(length(x.s) - length(replace(x.s, c, '')), 2)),
        'classes', aggregate(sequence(0, {len(CLASSES) - 1}), named_struct('x', 0D, 'df', -1), (t, i) -> CASE WHEN {shares}[x.e][i] = 0 THEN t ELSE named_struct(
            'x', t.x + pow(length(regexp_replace(x.s, concat('[^', substr({_literal(CLASSES)}[i], 2)), '')) - x.n * {shares}[x.e][i] / {count}[x.e], 2)
                 / (x.n * {shares}[x.e][i] / {count}[x.e]), 'df', t.df + 1) END)))""")
    df = put(df, f"""transform({column}, x -> named_struct('x', x, 'mean', aggregate(x.v, 0D, (t, a) -> t + a) / x.n,
        'high', aggregate(x.v, 0D, (t, a) -> t + IF(2 * a >= x.k, 1, 0)),
        'walk', aggregate(x.v, named_struct('runs', 0D, 'last', -1), (t, a) -> named_struct('runs', t.runs + IF(t.last = IF(2 * a >= x.k, 1, 0), 0, 1),
            'last', IF(2 * a >= x.k, 1, 0))).runs))""")
    df = put(df, f"""transform({column}, y -> named_struct('x', y.x, 'high', y.high, 'walk', y.walk, 'expected', 2 * y.high * (y.x.n - y.high) / y.x.n,
        'spread', aggregate(y.x.v, 0D, (t, a) -> t + pow(a - y.mean, 2)),
        'lag', aggregate(y.x.v, named_struct('sum', 0D, 'last', CAST(NULL AS DOUBLE)), (t, a) -> named_struct('sum', t.sum + coalesce(t.last * (a - y.mean), 0D),
            'last', a - y.mean)).sum))""")
    runs = "abs(y.walk - 1 - y.expected) / sqrt(y.expected * (y.expected - 1) / (y.x.n - 1))"
    serial = "abs(y.lag / y.spread + 1 / y.x.n) * sqrt(y.x.n)"
    df = put(df, f"""transform({column}, y -> named_struct('x', y.x, 'p', array(
        {_chi_tail('(y.x.k / y.x.n * y.x.squares - y.x.n)', '(y.x.k - 1)')},
        CASE WHEN y.x.classes.df > 0 THEN {_chi_tail('y.x.classes.x', 'y.x.classes.df')} END,
        CASE WHEN y.expected > 1 THEN 2 * {_upper_tail(runs)} ELSE 1e-9D END,
        CASE WHEN y.spread > 0 THEN 2 * {_upper_tail(serial)} ELSE 1e-9D END)))""")
    cauchy = "aggregate(filter(y.p, p -> p IS NOT NULL), 0D, (t, p) -> t + tan((0.5D - least(greatest(p, 1e-9D), 1 - 1e-9D)) * pi())) / size(filter(y.p, p -> p IS NOT NULL))"
    df = put(df, f"transform({column}, y -> named_struct('x', y.x, 'p', greatest(0.5D - atan({cauchy}) / pi(), 1e-9D)))")
    size = "CASE " + " ".join(f"WHEN y.x.n <= {n} THEN {i}" for i, n in enumerate(LENGTHS)) + f" ELSE {len(LENGTHS)} END"
    return put(df, f"""transform({column}, y -> named_struct('start', y.x.start, 'end', y.x.end, 'encoding', y.x.e, 'size', {size},
        'octaves', CAST(least(greatest(floor(-{GRID} * log2(y.p)), 0), {GRID * LEAST_OCTAVE}) AS INT), 'digest', xxhash64(y.x.s)))""")


def thresholds(df: DataFrame, column: str, rate: float = RATE) -> dict[tuple[int, int], int]:
    """(encoding, size class) -> the least grid step at which strings are given up as not random (Benjamini-Hochberg).

    One row a stratum and step reaches the driver, a number that the constants bound."""
    rows = (df.select(F.explode(column).alias("c")).groupBy("c.encoding", "c.size", "c.octaves").agg(F.count_distinct("c.digest").alias("n")).collect())
    strata: dict = {}
    for r in rows:
        strata.setdefault((r.encoding, r.size), {})[r.octaves] = r.n
    out = {}
    for key, steps in strata.items():
        total, below = sum(steps.values()), 0
        for step in sorted(steps, reverse=True):
            below += steps[step]
            if 2 ** (-step / GRID) * total <= rate * below:
                out[key] = step
    return out


def _long_enough(i: int, kind: str, pattern: str, group: int, least: int) -> Column:
    good = F.filter(kind, lambda x: F.length(F.regexp_extract(x.found, pattern, group) if group else x.found) >= least)
    return F.transform(good, lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), F.lit(i).alias("kind"), F.lit(None).cast("int").alias("encoding")))


def _of_kind(i: int) -> Column:
    return F.filter("spans", lambda x: x.kind == i)


def find_secrets(docs: DataFrame, text: str = "text", rate: float = RATE) -> DataFrame:
    """(doc_id, spans) of every row: an array of (start, end, kind, encoding) by start, then kind as listed; kind 3 is a
    string called by the battery, ``encoding`` its number in ENCODINGS (null for the patterns)."""
    ids = F.col("doc_id").cast("long") if "doc_id" in docs.columns else F.lit(None).cast("long")
    base = docs.select(ids.alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    found = with_spans(base, [(k, p) for k, p, _, _ in KINDS] + [(RANDOM, CANDIDATE)], "text")
    kept = [_long_enough(i, *kind) for i, kind in enumerate(KINDS)]
    spans = cut_lineage(tested(found.select("doc_id", F.concat(*kept).alias("base"), RANDOM), RANDOM))
    given_up = thresholds(spans, RANDOM, rate)
    limit = F.create_map(*[F.lit(x) for (e, s), step in sorted(given_up.items()) for x in (100 * e + s, step)]) if given_up else None
    called = F.filter(RANDOM, lambda x: (F.coalesce(x.octaves < limit[100 * x.encoding + x.size], F.lit(True)) if given_up else F.lit(True))
                      & ~F.exists("base", lambda b: (b.start < x.end) & (x.start < b.end)))
    more = F.transform(called, lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), F.lit(len(KINDS)).alias("kind"), x.encoding.alias("encoding")))
    ordered = F.transform(F.array_sort(F.transform(F.concat("base", more), lambda x: F.struct(x.start.alias("start"), x.kind.alias("kind"), x.end.alias("end"), x.encoding.alias("encoding")))),
                          lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), x.kind.alias("kind"), x.encoding.alias("encoding")))
    return spans.select("doc_id", ordered.alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS], F.lit(RANDOM))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x.kind], x.start.cast("string"), x.end.cast("string"))), ",")


def secret_report(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of every row."""
    found = find_secrets(docs, text)
    base = F.filter("spans", lambda x: x.kind < len(KINDS))
    return found.select("doc_id", *[F.size(_of_kind(i)).cast("long").alias(f"n_{k[0]}") for i, k in enumerate(KINDS)],
                        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
                        F.size(_of_kind(len(KINDS))).cast("long").alias("n_random"))
