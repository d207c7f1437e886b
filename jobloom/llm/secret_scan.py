"""Secret scans in DataFrame functions: fixed patterns, and a battery of randomness tests for other strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.llm.storage import cut

#: Kinds in order, their patterns, and the group and length that a match needs.
KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    # A run of 16 or more is a maximal run; shorter ones need not be listed to be dropped.
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
#: A cheap test that any text with a base match passes.
HINT = r"""AKIA|[0-9a-f]{16}|(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
#: Strings that the battery judges, and their inferred encodings with the size and order of the alphabet.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ENCODINGS = [
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", r"^[A-Z2-7]+$", "abcdefghijklmnopqrstuvwxyz234567"),
    ("base64", r"^[A-Za-z0-9+/_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
]
#: Columns that with_spans adds; their names are its own, so that no column of the input is lost.
BASE, JUDGED, SPANS = "secret_base_spans", "secret_judged", "secret_spans"
#: Fixed values, measured on ordinary strings: two to fifteen words of program sources as camel case, joined by _ or -, or
#: in capitals, with a number put in (20,000 in all), and for hex 8,000 padded counters, dates, made-up identifiers and
#: words of hex digits. By encoding: the square root of -log10 of the battery's p-value has a mean of so much a sign, and
#: those below it this deviation; it is taken for normal.
ORDINARY = [(0.105, 1.78), (0.036, 0.44), (0.060, 0.60)]
#: Bins of -log10(p) in which the false-discovery cut is found.
BIN, TOP = 0.05, 20.0
#: Elements that one fold appends to, and what lies between blocks is folded apart: appending copies the array.
BLOCK = 64


def _let(value: Column, body) -> Column:
    """body of a value that is evaluated, and stands in the plan, once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(v: Column) -> Column:
    """A named array in arrays of BLOCK elements."""
    last = F.greatest(F.ceil(F.size(v) / BLOCK).cast("int") - 1, F.lit(0))
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(v, i * BLOCK + 1, BLOCK))
    return F.filter(parts, lambda x: F.size(x) > 0)


def _before(values: Column, plus) -> Column:
    """For each of an array of longs what those before it add up to under an associative plus, from 0; near-linear work."""

    def folded(xs: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.expr("cast(array() as array<bigint>)").alias("out"))
        return F.aggregate(
            xs, start, lambda a, x: F.struct(plus(a["sum"], x).alias("sum"), F.array_append(a["out"], a["sum"]).alias("out"))
        )

    def joined(inner: Column) -> Column:
        offsets = folded(F.transform(inner, lambda x: x["sum"]))["out"]
        return F.flatten(F.zip_with(inner, offsets, lambda x, at: F.transform(x["out"], lambda v: plus(at, v))))

    return _let(F.transform(_let(values, _blocks), folded), joined)


def _with_matches(df: DataFrame, text: Column, named: dict[str, tuple[str, str]]) -> DataFrame:
    """df with arrays of (s, e, m), named: start, end and string of a pattern's matches, in code points.

    named gives pattern and hint; texts without the hint have no match. What lies between matches is measured. Each
    step is a column of its own, as Spark takes long to analyse nested ones.
    """
    none = F.expr("cast(array() as array<string>)")
    pair = lambda g, m: F.struct(F.length(g).cast("long").alias("g"), F.length(m).alias("n"), m.alias("m"))
    place = lambda at, x: F.struct((at + x["g"]).alias("s"), (at + x["g"] + x["n"]).alias("e"), x["m"].alias("m"))
    found, pairs, before, spans = {}, {}, {}, {}
    for name, (pattern, hint) in named.items():
        found[name] = F.when(text.rlike(hint), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
        pieces = F.when(F.size(name) > 0, F.slice(F.split(text, pattern, -1), 1, F.size(name))).otherwise(none)
        pairs[name] = F.zip_with(pieces, name, pair)
        before[f"{name}_before"] = _before(F.transform(name, lambda x: x["g"] + x["n"]), lambda a, x: a + x)
        spans[name] = F.zip_with(f"{name}_before", name, place)
    return df.withColumns(found).withColumns(pairs).withColumns(before).withColumns(spans).drop(*before)


def _base(k: int, pattern: str, group: int, least: int) -> Column:
    """Spans (s, k, e) of a kind's matches that are long enough."""
    long_enough = F.filter(f"secret_kind_{k}", lambda x: F.length(F.regexp_extract(x["m"], pattern, group)) >= least)
    return F.transform(long_enough, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))


def _tail(z: Column) -> Column:
    """Upper tail of the normal law: a rational approximation near 0, a continued fraction far out."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    fraction = 1 / (x + 1 / (x + 2 / (x + 3 / (x + 4 / (x + 5 / (x + 6))))))
    upper = F.exp(-x * x / 2) * 0.3989422804014327 * F.when(x < 3, poly).otherwise(fraction)
    return F.when(z >= 0, upper).otherwise(1 - upper)


def _keep(x: Column, names: list[str], **more: Column) -> Column:
    """A struct of some fields of x and more, so that each step of the battery reads what the last one made."""
    return F.struct(*[x[n].alias(n) for n in names], *[c.alias(n) for n, c in more.items()])


def _neighbours(values: Column) -> Column:
    """Pairs (a, b) of neighbouring elements."""
    n = F.size(values) - 1
    return F.arrays_zip(F.slice(values, 1, n).alias("a"), F.slice(values, 2, n).alias("b"))


def _total(values: Column, of=lambda v: v) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + of(v))


def _encoded(x: Column) -> Column:
    token = F.regexp_replace(x["m"], "=+$", "")
    last = len(ENCODINGS) - 1
    code = F.lit(last)
    for i in range(last - 1, -1, -1):
        code = F.when(token.rlike(ENCODINGS[i][1]), F.lit(i)).otherwise(code)
    return _keep(x, ["s", "e"], token=token, code=code)


def _signs(x: Column) -> Column:
    names = F.array(*[F.lit(n) for n, _, _ in ENCODINGS])
    alphabets = F.array(*[F.lit(a) for _, _, a in ENCODINGS])
    shown = F.when(x["code"] == len(ENCODINGS) - 1, F.translate(x["token"], "-_", "+/")).otherwise(F.lower(x["token"]))
    stratum = F.concat_ws(":", F.get(names, x["code"]), F.floor(F.log2(F.length(x["token"]))).cast("string"))
    signs = F.filter(F.split(shown, ""), lambda c: c != "")
    return _keep(x, ["s", "e", "code"], stratum=stratum, alphabet=F.get(alphabets, x["code"]), signs=signs)


def _measured(x: Column) -> Column:
    k, n = F.length(x["alphabet"]).cast("double"), F.size(x["signs"]).cast("double")
    squares = _total(
        F.array_distinct(x["signs"]),
        lambda d: F.pow(F.size(F.filter(x["signs"], lambda c: c == d)).cast("double"), 2),
    )
    values = F.transform(x["signs"], lambda c: F.instr(x["alphabet"], c).cast("double") - 1)
    return _keep(x, ["s", "e", "code", "stratum"], n=n, k=k, values=values, chi=F.greatest(squares * k / n - n, F.lit(0.0)))


def _halved(x: Column) -> Column:
    high = F.transform(x["values"], lambda v: F.when(v >= x["k"] / 2, 1.0).otherwise(0.0))
    return _keep(x, ["s", "e", "code", "stratum", "n", "k", "values", "chi"], high=high, mean=_total(x["values"]) / x["n"])


def _summed(x: Column) -> Column:
    ones = _total(x["high"])
    runs = 1 + _total(_neighbours(x["high"]), lambda y: F.when(y["a"] != y["b"], 1.0).otherwise(0.0))
    scatter = _total(x["values"], lambda v: (v - x["mean"]) * (v - x["mean"]))
    product = _total(_neighbours(x["values"]), lambda y: (y["a"] - x["mean"]) * (y["b"] - x["mean"]))
    both = 2 * ones * (x["n"] - ones)
    return _keep(x, ["s", "e", "code", "stratum", "n", "k", "chi"], runs=runs, both=both, scatter=scatter, product=product)


def _deviations(x: Column) -> Column:
    """Normal deviates of the three tests; null where a test has no spread.

    With few signs a cell, chi-squared has less than twice its mean as variance; mean and variance are matched by a
    share of a chi-squared of more degrees of freedom.
    """
    n = x["n"]
    stretch = n / (n - 1)
    free = (x["k"] - 1) * stretch
    uniform = (F.pow(x["chi"] * stretch / free, 1 / 3) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    spread = x["both"] * (x["both"] - n) / (n * n * (n - 1))
    runs = F.when(spread > 0, F.abs(x["runs"] - x["both"] / n - 1) / F.sqrt(spread))
    serial = F.when(x["scatter"] > 0, F.abs(x["product"] / x["scatter"] + 1 / n) * F.sqrt(n))
    return _keep(x, ["s", "e", "code", "stratum", "n"], uniform=uniform, runs=runs, serial=serial)


def _looking_random(x: Column) -> Column:
    """The least of the battery's three p-values times three, under the law of random strings.

    Uniformity: chi-squared over the alphabet, by the cube-root normal form, upper tail. Runs: of signs in the upper
    and the lower half. Serial correlation: of neighbouring signs' places in the alphabet. A string that shows one half
    only has the runs p-value 0.5 to the power n - 1, one of a single sign the serial p-value 0.
    """
    runs = F.coalesce(2 * _tail(x["runs"]), F.pow(F.lit(0.5), x["n"] - 1))
    serial = F.coalesce(2 * _tail(x["serial"]), F.lit(0.0))
    least = 3 * F.least(_tail(x["uniform"]), runs, serial)
    return _keep(x, ["s", "e", "code", "stratum", "n"], random=F.greatest(F.least(F.lit(1.0), least), F.lit(1e-300)))


def _standing(x: Column) -> Column:
    """How many deviations below the mean of ordinary strings of its encoding and length the string stands."""
    means, spreads = (F.array(*[F.lit(o[i]) for o in ORDINARY]) for i in (0, 1))
    z = (F.get(means, x["code"]) * x["n"] - F.sqrt(-F.log10(x["random"]))) / F.get(spreads, x["code"])
    return _keep(x, ["s", "e", "stratum"], z=z)


def _judged(x: Column) -> Column:
    """The p-value of the hypothesis that the string is ordinary: the share of such strings that look as random or more so."""
    return _keep(x, ["s", "e", "stratum"], p=_tail(x["z"]))


def _candidates() -> Column:
    """Array of (s, e, stratum, p) of the strings in JUDGED that the battery judges; p as in _judged.

    A candidate has a digit and a letter. Its encoding is the smallest alphabet that holds it; the stratum is encoding
    and length class (doubling), so that each length is held to its own cut.
    """
    found = F.filter(JUDGED, lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]"))
    for step in (_encoded, _signs, _measured, _halved, _summed, _deviations, _looking_random, _standing, _judged):
        found = F.transform(found, step)
    return found


def cuts(judged: DataFrame, rate: float) -> dict[str, float]:
    """Per stratum the p-value at or below which strings are secrets; judged has the candidates in the column JUDGED.

    The step-up rule over all candidates of the corpus: the largest p with p <= rate * (candidates at or below p) / all
    candidates of the stratum, so that of what is called a secret a share of about `rate` is ordinary. It is read off
    bins of -log10(p), each counted with its largest p, so no more than a few hundred rows a stratum are ranked.
    """
    p = judged.select(F.explode(JUDGED).alias("c")).select("c.stratum", "c.p")
    bin_no = F.floor(F.least(F.lit(TOP), -F.log10(F.greatest("p", F.lit(1e-300)))) / BIN).cast("int")
    bins = p.groupBy("stratum", bin_no.alias("bin")).agg(F.count("*").alias("n"))
    by = Window.partitionBy("stratum")
    upto = F.sum("n").over(by.orderBy(F.col("bin").desc()))
    edge = F.pow(F.lit(10.0), -F.col("bin") * BIN)
    ranked = bins.select("stratum", edge.alias("edge"), upto.alias("upto"), F.sum("n").over(by).alias("m"))
    passed = ranked.where(F.col("edge") <= rate * F.col("upto") / F.col("m"))
    return {r.stratum: r.cut for r in passed.groupBy("stratum").agg(F.max("edge").alias("cut")).collect()}


def with_judged(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with BASE, the spans (s, k, e) of the base kinds by start and kind, and JUDGED, the candidates with their p-values."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kinds = {f"secret_kind_{k}": (pattern, HINT) for k, (_, pattern, _, _) in enumerate(KINDS)}
    df = _with_matches(docs, text, kinds | {JUDGED: (CANDIDATE, CANDIDATE)})
    base = F.array_sort(F.concat(*[_base(k, *rest) for k, (_, *rest) in enumerate(KINDS)]))
    return df.withColumns({BASE: base, JUDGED: _candidates()}).drop(*kinds)


def with_spans(judged: DataFrame, rate: float) -> DataFrame:
    """judged with SPANS in place of JUDGED: arrays of (s, k, e), k 0 to 2 for the base kinds and 3 for `random`, by start and kind.

    A candidate is a random span when its stratum's false-discovery control calls it a secret and no base span holds
    it. Only the cuts, a few numbers per stratum, come to the driver.
    """
    pairs = [F.lit(x) for pair in sorted(cuts(judged, rate).items()) for x in pair] or [F.lit(""), F.lit(-1.0)]
    cut_of = lambda s: F.coalesce(F.try_element_at(F.create_map(*pairs), s), F.lit(-1.0))
    called = F.filter(JUDGED, lambda c: c["p"] <= cut_of(c["stratum"]))
    more = F.transform(called, lambda c: F.struct(c["s"].alias("s"), F.lit(3).alias("k"), c["e"].alias("e")))
    df = judged.withColumn(SPANS, F.array_sort(F.concat(BASE, more))).drop(JUDGED)
    # In order of start, base spans first, a span is held when a base span before it ends no earlier.
    ends = f"{SPANS}_ends"
    own = F.transform(SPANS, lambda x: F.when(x["k"] < 3, x["e"]).otherwise(0))
    df = df.withColumn(ends, _before(own, lambda a, e: F.greatest(a, e)))
    pair = lambda x, end: F.struct(x.alias("x"), ((x["k"] < 3) | (end < x["e"])).alias("stays"))
    stay = F.filter(F.zip_with(SPANS, ends, pair), lambda y: y["stays"])
    return df.withColumn(SPANS, F.transform(stay, lambda y: y["x"])).drop(ends)


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k[0]) for k in KINDS], F.lit("random"))
    one = lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.05) -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, base_sha256, spans) for every row, whole texts.

    Texts are read once: base spans and judged candidates, without the texts, go to the checkpoint folder, and the
    false-discovery cuts come from there. Null and empty texts have no spans: zeros, the hash of the empty string, and
    an empty string. Repeated rows and null ids are kept, each with its own result; an empty table gives no rows; other
    columns are not read.
    """
    judged = with_judged(docs.select(F.col(id_col), F.col(text_col)), text_col)
    found = with_spans(cut(judged.select(id_col, BASE, JUDGED)), rate)
    count = lambda k: F.size(F.filter(BASE, lambda x: x["k"] == k)).cast("bigint")
    return found.select(
        id_col,
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(written(F.col(BASE)), 256).alias("base_sha256"),
        written(F.col(SPANS)).alias("spans"),
    )


def masked(df: DataFrame, text_col: str, spans_col: str, mark: str) -> DataFrame:
    """df with each group of overlapping spans, which come in order, of its text replaced by mark; spans_col is used up.

    Pieces between marks are cut from blocks of the text, so that no piece is counted off from the text's beginning.
    """
    text, gaps, last = F.col(text_col).cast("string"), "secret_gaps", "secret_last"
    stops = F.transform(spans_col, lambda x: x["e"])
    df = df.withColumns({last: F.array_max(stops), gaps: _before(stops, lambda a, x: F.greatest(a, x))})
    pairs = F.zip_with(gaps, spans_col, lambda at, x: F.struct(at.alias("a"), x["s"].alias("b")))
    df = df.withColumn(gaps, F.filter(pairs, lambda x: x["b"] >= x["a"])).withColumn(gaps, _blocks(F.col(gaps)))

    def part(xs: Column) -> Column:
        size = F.element_at(xs, -1)["b"] - xs[0]["a"]
        return F.struct(xs.alias("xs"), F.substring(text, (xs[0]["a"] + 1).cast("int"), size.cast("int")).alias("part"))

    def cut_up(y: Column) -> Column:
        at = y["xs"][0]["a"]
        return F.transform(
            y["xs"], lambda x: F.substring(y["part"], (x["a"] - at + 1).cast("int"), (x["b"] - x["a"]).cast("int"))
        )

    df = df.withColumn(gaps, F.transform(gaps, part)).withColumn(gaps, F.flatten(F.transform(gaps, cut_up)))
    tail = F.substring(text, (F.col(last) + 1).cast("int"), F.length(text))
    whole = F.array_join(F.array_append(gaps, tail), mark)
    return df.withColumn(text_col, F.when(F.size(spans_col) > 0, whole).otherwise(text)).drop(gaps, last, spans_col)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", rate: float = 0.05) -> DataFrame:
    """docs, same columns, with every span of its text replaced by mark; overlapping spans give one mark.

    Null texts stay null; repeated rows and null ids are kept; an empty table gives no rows. The cuts take a pass of
    their own over the texts, which judges candidates only.
    """
    return masked(with_spans(with_judged(docs, text_col), rate), text_col, SPANS, mark).select(docs.columns)
