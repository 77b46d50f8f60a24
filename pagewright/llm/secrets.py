"""Secret scan: fixed forms, and sliding-window Shannon entropy over candidate strings. DataFrame functions only.

A candidate is a run of ``[A-Za-z0-9+/_=-]``. Its class is the narrowest of hex, letters and digits, base64 that holds all
its characters. A window of ``WINDOW`` characters slides over it. One character comes and one goes at each step; only
their counts in the window change, and with them the sum of ``c log2 c``, so the entropy of each window follows from that
of the one before. The highest is compared with the class's threshold. An allow-list drops what is no secret though it
looks random; its patterns are possessive, so that long runs take time in proportion and no stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.spans import clear_of, find, listed, merged

KINDS = ["assign", "access", "hex"]
WINDOW = 20
#: Bits of entropy from which a window of its class is random; 20 characters have at most 4.32, and 4 of hex.
THRESHOLDS = {"hex": 3.0, "alnum": 3.7, "base64": 3.9}
PATTERNS = {
    "assign": ("(?i)pass|secret|token|key", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""),
    "access": ("AKIA", "AKIA[A-Z0-9]{12,}+"),
    "hex": ("[0-9a-f]{32}", "[0-9a-f]{32,}+"),
    "random": ("[A-Za-z0-9+/_=-]{20}", "[A-Za-z0-9+/_=-]{20,}+"),
}
#: Never secrets: words and numbers only, dashed or snake-case words, dates and paths of words, ids of one
#: repeated character, UUIDs, and strings that say they are examples.
ALLOWED = [
    r"^[A-Za-z]+$",
    r"^[0-9_=/+-]+$",
    r"^[A-Za-z]+[0-9]{0,4}$",
    r"^(?:/?+[A-Za-z]{2,}+[0-9]{0,4}+[/_=+-]++)++[A-Za-z]*+[0-9]{0,4}+$",
    r"^(.)\1++$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|xxxx|abcdefgh|12345678",
]


def clog(c: Column) -> Column:
    return F.when(c > 0, c * F.log2(F.greatest(c, F.lit(1)).cast("double"))).otherwise(F.lit(0.0))


def top_entropy(text: Column, window: int = WINDOW) -> Column:
    """The highest entropy of a window of an ASCII string, in bits; of the whole string if it is shorter."""
    n, wide = F.length(text), F.lit(float(window))

    def walk(codes: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            before = F.slice(codes, F.greatest(i - window, F.lit(0)) + 1, F.least(i, F.lit(window)))
            count = lambda c: F.size(before) - F.size(F.array_remove(before, c))
            comes, goes = F.get(codes, i), F.get(codes, i - window)
            was_in, was_out = count(comes), F.coalesce(count(goes), F.lit(0))
            lost = F.when(i >= window, clog(was_out - 1) - clog(was_out)).otherwise(F.lit(0.0))
            s = F.when(F.coalesce(comes == goes, F.lit(False)), acc["s"]).otherwise(acc["s"] + clog(was_in + 1) - clog(was_in) + lost)
            size = F.least((i + 1).cast("double"), wide)
            full = i + 1 >= F.least(n, F.lit(window))
            return F.struct(s.alias("s"), F.when(full, F.greatest(acc["h"], F.log2(size) - s / size)).otherwise(acc["h"]).alias("h"))

        start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("h"))
        return F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), start, step, lambda acc: acc["h"])

    codes = F.transform(F.split(text, ""), F.ascii)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.element_at(F.transform(F.array(codes), walk), 1))


def is_random(text: Column) -> Column:
    """Random enough for its class, and on no allow-list."""
    limit = F.when(text.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), THRESHOLDS["hex"]).when(text.rlike("^[A-Za-z0-9]+$"), THRESHOLDS["alnum"]).otherwise(THRESHOLDS["base64"])
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | text.rlike(pattern)
    return F.when(allowed, F.lit(False)).otherwise(top_entropy(text) >= limit)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and, by kind, ``assign, access, hex, random array<struct<s,e,m>>`` (places in code points, end exclusive).

    ``random`` has the candidates that the entropy finds and no other kind overlaps. Null texts count as empty; repeated
    rows are scanned alike; other columns are ignored; an empty table gives an empty one.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = find(df, PATTERNS).drop("text")
    value = lambda m: F.regexp_extract(m, r"""[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$""", 1)
    df = df.withColumn("assign", F.filter("assign", lambda x: F.length(value(x["m"])) >= 8))
    return df.withColumn("random", F.filter(clear_of(F.col("random"), F.concat("assign", "access", "hex")), lambda x: is_random(x["m"])))


def digests(found: DataFrame) -> DataFrame:
    """The columns ``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of a scan."""
    base, all_ = merged(KINDS), [*KINDS, "random"]
    return found.select("doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS], F.sha2(listed(base, KINDS).cast("binary"), 256).alias("base_sha256"), listed(merged(all_), all_).alias("spans"))
