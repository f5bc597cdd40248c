"""Find secrets: fixed patterns, and strings that stand up to a battery of randomness tests.

Patterns give the base spans. Every other long token is tested for being uniform
noise over the alphabet of its inferred encoding: chi-squared of the character
counts, the number of runs above and below the middle of the alphabet, and the
correlation of neighbours, joined by Fisher's method into one p-value. Noise has
uniform p-values, words have values near 0. Per encoding and length band the
number of truly random tokens follows from the p-values above 0.2, and a
token is reported when its p-value exceeds the least threshold at which the
estimated share of non-random tokens above it is at most ``q``: short tokens,
where the tests are weak and words slip through, get a higher threshold.

All of it is DataFrame functions. Null texts count as empty, ids may be null or
repeated, extra columns are ignored. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import freeze

# The base patterns, in the order of kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"[A-Za-z0-9+/_-]{20,}+={0,2}+"
DIGITS = "0123456789"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (  # name, what its strings look like, alphabet; the first that fits counts
    ("decimal", r"^[0-9]+$", DIGITS),
    ("hex", r"^[0-9a-f]+$", DIGITS + "abcdef"),
    ("hex_upper", r"^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", r"^[A-Z2-7]+=*$", UPPER + "234567"),
    ("alnum", r"^[A-Za-z0-9]+=*$", UPPER + LOWER + DIGITS),
    ("base64", r"^[A-Za-z0-9+/]+=*$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", r"^[A-Za-z0-9_-]+=*$", UPPER + LOWER + DIGITS + "-_"),
    ("mixed", r"", UPPER + LOWER + DIGITS + "+/-_"),
)
BANDS = (20, 28, 40, 64, 128)
BINS = 100
SURE = 20  # from this bin on only noise is expected
FAR = 12.0  # the score of a test that cannot be computed
_TESTED = "array<struct<start:int,end:int,token:bigint,stratum:int,p:double>>"
_SPAN = "array<struct<start:int,rank:int,end:int,value:string>>"


def running_sum(values: Column) -> Column:
    """Inclusive running sums of an array in log n passes of additions at doubling distance."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)).cast("double"))).cast("int"))

    def add(acc, k):
        far = F.pow(F.lit(2.0), k).cast("int")
        return F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - far), F.lit(0)))

    return F.aggregate(rounds, values, add)


def matches(text: Column, pattern: str, rank: int) -> Column:
    """Spans of all leftmost non-overlapping matches. What lies between them gives their places."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    steps = F.zip_with(hits, F.slice(between, F.lit(1), F.size(hits)), lambda h, b: F.length(h) + F.length(b))
    spans = F.zip_with(hits, running_sum(steps), lambda h, e: F.struct(
        (e - F.length(h)).alias("start"), F.lit(rank).alias("rank"), e.alias("end"), h.alias("value")))
    return F.when(F.size(hits) > 0, spans).otherwise(F.array().cast(_SPAN))


def upper_tail(z: Column) -> Column:
    """P(N > z) for z >= 0, by the rational approximation 26.2.17 of Abramowitz and Stegun."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * z)
    poly = t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (
        F.lit(1.781477937) + t * (F.lit(-1.821255978) + t * F.lit(1.330274429)))))
    return F.greatest(F.lit(0.3989422804014327) * F.exp(-z * z / 2) * poly, F.lit(1e-300))


def _encoding(value: Column) -> Column:
    """Index into ENCODINGS."""
    found = F.lit(len(ENCODINGS) - 1)
    for i in range(len(ENCODINGS) - 2, -1, -1):
        found = F.when(value.rlike(ENCODINGS[i][1]), F.lit(i)).otherwise(found)
    return found


def _with(items: Column, keep: tuple, **new) -> Column:
    """Each struct of an array with further fields. The next step reads them as fields, so nothing is computed twice."""
    return F.transform(items, lambda s: F.struct(
        *[s[k].alias(k) for k in keep], *[f(s).alias(k) for k, f in new.items()]))


def _total(values: Column, zero) -> Column:
    return F.aggregate(values, F.lit(zero), lambda a, x: a + x)


def _neighbours(values: Column, f) -> Column:
    """``f`` of every two neighbours; null behind the last."""
    return F.zip_with(values, F.slice(values, F.lit(2), F.size(values)), f)


def tested(spans: Column) -> Column:
    """Tokens with the hash of their value, their stratum and their p-value for being uniform noise."""
    where = ("start", "end")
    t = _with(spans, where, value=lambda s: s["value"], enc=lambda s: _encoding(s["value"]))
    t = _with(t, (*where, "value", "enc"), body=lambda s: F.regexp_replace(s["value"], "=+$", ""),
              alphabet=lambda s: F.get(F.array(*[F.lit(a) for _, _, a in ENCODINGS]), s["enc"]))
    t = _with(t, (*where, "value", "enc", "body"), chars=lambda s: F.split(s["body"], ""),
              alphabet=lambda s: s["alphabet"], n=lambda s: F.length(s["body"]).cast("double"),
              size=lambda s: F.length(s["alphabet"]).cast("double"))
    t = _with(
        t, (*where, "value", "enc", "n", "size"),
        code=lambda s: F.transform(s["chars"], lambda c: F.position(c, s["alphabet"]).cast("double") - 1),
        squares=lambda s: F.aggregate(F.array_distinct(s["chars"]), F.lit(0.0), lambda a, c: a + F.pow(
            s["n"] - F.length(F.replace(s["body"], c, F.lit(""))), F.lit(2.0))))
    t = _with(t, (*where, "value", "enc", "n", "size", "code", "squares"),
              half=lambda s: F.transform(s["code"], lambda x: (x >= s["size"] / 2).cast("int")),
              mean=lambda s: _total(s["code"], 0.0) / s["n"])
    t = _with(
        t, (*where, "value", "enc", "n", "size", "squares"), high=lambda s: _total(s["half"], 0).cast("double"),
        runs=lambda s: 1 + _total(_neighbours(s["half"], lambda a, b: F.coalesce(F.abs(a - b), F.lit(0))), 0),
        var=lambda s: F.aggregate(s["code"], F.lit(0.0), lambda a, x: a + (x - s["mean"]) * (x - s["mean"])),
        pairs=lambda s: _total(_neighbours(s["code"], lambda a, b: F.coalesce(
            (a - s["mean"]) * (b - s["mean"]), F.lit(0.0))), 0.0))
    t = _with(
        t, (*where, "value", "enc", "n", "runs"),
        chi_z=lambda s: (s["size"] / s["n"] * s["squares"] - s["n"] - (s["size"] - 1))
        / F.sqrt(2 * (s["size"] - 1) * (s["n"] - 1) / s["n"]),
        expected=lambda s: 2 * s["high"] * (s["n"] - s["high"]) / s["n"] + 1,
        serial_z=lambda s: F.when(s["var"] > 0, F.abs(s["pairs"] / s["var"] + 1 / (s["n"] - 1)) * F.sqrt(s["n"])).otherwise(FAR))
    t = _with(t, (*where, "value", "enc", "runs", "chi_z", "expected", "serial_z"),
              spread=lambda s: (s["expected"] - 1) * (s["expected"] - 2) / (s["n"] - 1))
    t = _with(t, (*where, "value", "enc", "chi_z", "serial_z"),
              runs_z=lambda s: F.when(s["spread"] > 0, F.abs(s["runs"] - s["expected"]) / F.sqrt(s["spread"])).otherwise(FAR))
    two_sided = lambda z: F.log(F.least(2 * upper_tail(z), F.lit(1.0)))
    t = _with(t, (*where, "value", "enc"), y=lambda s: -(
        F.log(F.when(s["chi_z"] >= 0, upper_tail(s["chi_z"])).otherwise(1 - upper_tail(-s["chi_z"])))
        + two_sided(s["runs_z"]) + two_sided(s["serial_z"])))
    band = lambda s: sum(((F.length(s["value"]) >= b).cast("int") for b in BANDS[1:]), F.lit(0))
    return _with(t, where, token=lambda s: F.xxhash64(s["value"]), stratum=lambda s: s["enc"] * len(BANDS) + band(s),
                 p=lambda s: F.least(F.exp(-s["y"]) * (1 + s["y"] + s["y"] * s["y"] / 2), F.lit(1.0)))


def measure(docs: DataFrame) -> DataFrame:
    """Base spans and tested tokens of every document, without the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    assign = F.filter(matches(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 6)
    access = F.filter(F.when(text.contains("AKIA"), matches(text, ACCESS, 1)).otherwise(F.array().cast(_SPAN)),
                      lambda s: s["end"] - s["start"] >= 20)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), assign.alias("assign"), access.alias("access"),
                       matches(text, HEX, 2).alias("hex"), matches(text, TOKEN, 3).alias("token"))
    spans = F.array_sort(F.transform(F.concat("assign", "access", "hex"), lambda s: F.struct(
        s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))))
    base = base.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
                       spans.alias("base"), "token")
    free = F.filter("token", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    base = base.select("doc_id", "n_assign", "n_access", "n_hex", "base", free.alias("free"))
    return base.select("doc_id", "n_assign", "n_access", "n_hex", "base", F.when(F.size("free") > 0, tested(F.col("free"))).otherwise(F.array().cast(_TESTED)).alias("tokens"))


def thresholds(measured: DataFrame, q: float) -> dict[int, float]:
    """Least p-value to report per stratum; at most encodings x bands rows reach the driver.

    Equal tokens count once: a secret pasted everywhere is one test.
    """
    each = measured.select(F.explode("tokens").alias("t")).select("t.*")
    binned = each.select("token", "stratum", F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    bins = binned.distinct().groupBy("stratum", "bin").agg(F.count("*").alias("n"))
    per = bins.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m")).select(
        "stratum", F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.coalesce(
            F.try_element_at("m", b), F.lit(0).cast("long"))).alias("c"))
    above = lambda b: F.aggregate(F.slice("c", b + 1, F.lit(BINS)), F.lit(0).cast("long"), lambda a, x: a + x)
    random = above(F.lit(SURE)) / (1 - SURE / BINS)
    good = F.filter(F.sequence(F.lit(1), F.lit(SURE)), lambda b: above(b) * (1 - q) <= random * (1 - b / BINS) + 1e-9)
    return {r["stratum"]: r["b"] / BINS for r in per.select("stratum", F.array_min(good).alias("b")).collect()}


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, q: float = 0.1) -> DataFrame:
    """Counts, hash of the base spans and all spans per document.

    One pass over the text writes a small table; the thresholds come from it and
    are then applied to it.
    """
    measured = freeze(measure(docs))
    least = thresholds(measured, q)
    table = F.array(*[F.lit(float(least.get(s, 2.0))) for s in range(len(ENCODINGS) * len(BANDS))])
    chosen = F.filter("tokens", lambda t: t["p"] > F.get(table, t["stratum"]))
    added = F.transform(chosen, lambda t: F.struct(
        t["start"].alias("start"), F.lit(3).alias("rank"), t["end"].alias("end")))
    return measured.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", added))).alias("spans"), F.size(chosen).cast("long").alias("n_random"))
