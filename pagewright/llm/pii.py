"""Personal data: fixed forms, and boosted trees over candidate spans. DataFrame functions only on the rows.

Generators of high recall propose spans, which may overlap: runs of digits with separators, account numbers, and
addresses that are spelt out. Features of a candidate's format and of the text around it go through gradient-boosted
trees, which are part of the plan as CASE expressions, and a threshold for each generator selects what to redact.

The trees are trained on the driver, on texts made from templates (``examples``): no such labels come with a corpus. The
features of these few texts are computed by the same expressions.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.spans import clear_of, find, listed, merged

KINDS = ["email", "ip", "card", "phone"]
MORE = ["mail", "account", "number"]
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
BASE = {
    "email": ("@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", r"[0-9](?:[\x20-]?+[0-9]){11,}+"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
GENERATORS = {
    "mail": (r"(?i)[(\[{]\x20?at\x20?[)\]}]", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+\x20?[(\[{]\x20?at\x20?[)\]}]\x20?[a-z0-9-]{1,63}+(?:(?:\.|\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?)[a-z0-9-]{1,63}+){1,6}+"),
    "account": (r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?+[A-Z0-9]{4}){2,7}+(?:\x20?+[A-Z0-9]{1,3})?+"),
    "number": (r"[0-9][\x20()./-]{0,2}[0-9][\x20()./-]{0,2}[0-9]", r"\(?[0-9](?:[\x20()./-]{0,2}+[0-9]){6,}+"),
}
BEFORE, AFTER = 24, 8
FEATURES = 18


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the check digit of a string of digits is right."""
    double = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    worth = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 1, double(x.cast("int"))).otherwise(x.cast("int")))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(df: DataFrame) -> DataFrame:
    """``df`` with the columns of ``KINDS``: matches of the fixed forms that pass their tests."""
    df = find(df, BASE)
    n = lambda x: F.length(digits_of(x["m"]))
    return df.withColumns({
        "ip": F.filter("ip", lambda x: x["m"].rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")),
        "card": F.filter("card", lambda x: F.when(n(x) <= 19, luhn(digits_of(x["m"]))).otherwise(F.lit(False))),
        "phone": F.filter("phone", lambda x: n(x).between(9, 15)),
    })


def features(m: Column, before: Column, after: Column) -> Column:
    """``array<double>`` of ``FEATURES`` numbers about a candidate and its context."""
    count = lambda pattern: F.length(F.regexp_replace(m, f"[^{pattern}]", ""))
    near = lambda words: before.rlike(f"(?i)(?:{words})[^a-z]*$")
    digits = digits_of(m)
    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: g != "")
    sizes = F.transform(groups, F.length)
    values = [
        F.length(m), F.length(digits), count("A-Za-z"), count(r"\x20"), count("."), count("/"), count(r"\-"), count("()"), F.size(groups), F.array_max(sizes), F.array_min(sizes),
        F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False)).cast("int"),
        near("tel|phone|call|fax|mobile?|cell|whatsapp|sms|telefon|tel[eé]fono|portable|handy").cast("int"),
        near("card|visa|iban|account|konto|cuenta|compte|ssn|social security|passport|ausweis|dni|tax id").cast("int"),
        near(r"order|invoice|isbn|version|page|ref|no\.|nr\.|year|price|total|[€$#v]|date|doi|line|id").cast("int"),
        before.rlike("[A-Za-z0-9_.,/:#-]$").cast("int"), after.rlike("^[A-Za-z0-9_%/-]").cast("int"), before.rlike(r"(?i)(?:mail|contact|write|reach)[^a-z]*$").cast("int"),
    ]
    return F.array(*[F.coalesce(v.cast("double"), F.lit(0.0)) for v in values])


def candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds for each generator ``array<struct<s,e,m,f>>``; ``f`` are the features."""

    def told(name: str) -> Column:
        t = F.col(text)

        def one(x: Column) -> Column:
            low = F.greatest(x["s"] - BEFORE, F.lit(0))
            return F.struct(x["s"], x["e"], x["m"], features(x["m"], F.substring(t, low + 1, x["s"] - low), F.substring(t, x["e"] + 1, F.lit(AFTER))).alias("f"))

        return F.transform(name, one)

    df = find(df, GENERATORS, text)
    return df.withColumns({name: told(name) for name in GENERATORS})


@dataclass
class Trees:
    """Boosted trees as nested (feature, threshold, left, right) with leaf values, a bias, and a threshold by generator."""

    bias: float
    trees: list
    limits: dict[str, float]

    def score(self, f: Column) -> Column:
        """The sum of the trees for an array of features."""

        def node(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            k, cut, low, high = tree
            return F.when(F.get(f, F.lit(k)) <= cut, node(low)).otherwise(node(high))

        total = F.lit(self.bias)
        for tree in self.trees:
            total = total + node(tree)
        return total


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float):
    """A regression tree on gradients, by exact search over at most 32 cuts of each feature."""
    leaf = float(rate * g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(x) < 20:
        return leaf
    best, score = None, g.sum() ** 2 / (h.sum() + 1.0) + 1e-3
    for k in range(x.shape[1]):
        for cut in np.unique(np.quantile(x[:, k], np.linspace(0, 1, 33)))[:-1]:
            left = x[:, k] <= cut
            if not 5 <= left.sum() <= len(x) - 5:
                continue
            gain = g[left].sum() ** 2 / (h[left].sum() + 1.0) + g[~left].sum() ** 2 / (h[~left].sum() + 1.0)
            if gain > score:
                best, score = (k, float(cut), left), gain
    if best is None:
        return leaf
    k, cut, left = best
    return k, cut, grow(x[left], g[left], h[left], depth - 1, rate), grow(x[~left], g[~left], h[~left], depth - 1, rate)


def apply(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    k, cut, low, high = tree
    return np.where(x[:, k] <= cut, apply(low, x), apply(high, x))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 20, depth: int = 3, rate: float = 0.4) -> tuple[float, list]:
    bias = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    z, trees = np.full(len(x), bias), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        trees.append(grow(x, y - p, p * (1 - p), depth, rate))
        z = z + apply(trees[-1], x)
    return bias, trees


def examples(n: int = 1800, seed: int = 7) -> list[tuple[str, int]]:
    """Texts with one candidate each, and whether it is personal data."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(["th", "er", "an", "on", "que", "ch", "en", "lo", "st", "ma"]) for _ in range(r.randint(1, 4)))
    yes = [
        lambda: f"{r.choice(['phone', 'Tel.', 'call me at', 'Fax:', 'mobile', 'WhatsApp', 'Telefon:', 'teléfono'])} {r.choice([f'({d(3)}) {d(3)}-{d(4)}', f'{d(3)}-{d(3)}-{d(4)}', f'0{d(2)} {d(3)} {d(4)}', f'0{d(3)}/{d(7)}', f'{d(3)}.{d(3)}.{d(4)}', d(10)])}",
        lambda: f"{r.choice(['SSN', 'social security', 'ssn:'])} {d(3)}-{d(2)}-{d(4)}",
        lambda: f"{r.choice(['card', 'Visa', 'my card:'])} {d(4)} {d(4)} {d(4)} {d(4)}",
        lambda: f"{r.choice(['IBAN', 'account', 'Konto', 'iban:', 'cuenta'])} {r.choice(['DE', 'FR', 'ES', 'GB'])}{d(2)} {' '.join(d(4) for _ in range(4))} {d(2)}",
        lambda: f"{r.choice(['mail', 'contact', 'write to', word()])} {word()}.{word()} {r.choice(['(at)', '[at]', '{at}'])} {word()} {r.choice(['(dot)', '[dot]', '.'])} {r.choice(['com', 'org', 'de'])}",
    ]
    no = [
        lambda: f"{word()} {d(r.randint(7, 20))}",
        lambda: f"{r.choice(['order', 'invoice', 'ref', 'ISBN', 'no.', 'id', '#'])} {r.choice([d(9), f'{d(3)}-{d(1)}-{d(5)}-{d(3)}-{d(1)}', f'{d(4)} {d(4)}', f'{d(3)}-{d(3)}-{d(4)}'])}",
        lambda: f"{word()} {r.choice(['19', '20'])}{d(2)}-{d(2)}-{d(2)}{r.choice(['', f' {d(2)}'])}",
        lambda: f"{r.choice(['version', 'v', 'page', 'total', '$', 'price'])} {d(2)}.{d(2)}.{d(2)}.{d(2)}",
        lambda: f"{word()} {d(3)}.{d(3)}.{d(3)}",
        lambda: f"{word()} {' '.join(d(r.randint(1, 2)) for _ in range(r.randint(7, 12)))}",
        lambda: f"{word()} {d(4)} {d(4)} {d(4)} {d(4)}",
        lambda: f"{word()} {d(16)} {d(r.randint(14, 19))}",
        lambda: f"{word()} {d(r.randint(21, 70))}",
        lambda: f"{word()} {d(4)}-{d(4)}-{d(4)}-{d(4)} {d(r.randint(12, 20))}",
        lambda: f"{word()} {d(r.randint(16, 20))}.{d(1)}.{d(1)}.{d(1)}",
        lambda: f"{word()} {word().upper()[:2]}{d(2)} {''.join(r.choice('ABCDEF') for _ in range(8))}",
        lambda: f"{word()} {r.choice('ABX')}{r.choice('ABX')}{d(2)}{d(8)}",
    ]
    out = []
    for _ in range(n):
        label = r.random() < 0.5
        out.append((f"{word()} {word()} {r.choice(yes if label else no)()}{r.choice([' ', '. ', ', ', ''])}{word() if r.random() < 0.7 else ''}".rstrip() + " ", int(label)))
    return out


def train(spark: SparkSession, precision: float = 0.99) -> Trees:
    """Trees from four of five examples, and by generator the lowest threshold of that precision on the others."""
    made = [(k, t, y) for k, (t, y) in enumerate(examples())]
    found = candidates(spark.createDataFrame(made, "id int, text string, y int"))
    rows = [(r["id"], r["y"], name, x["f"]) for r in found.collect() for name in GENERATORS for x in r[name]]
    x, y = np.array([r[3] for r in rows]), np.array([r[1] for r in rows], float)
    held = np.array([r[0] % 5 == 0 for r in rows])
    bias, trees = boost(x[~held], y[~held])
    z = bias + sum(apply(t, x) for t in trees)
    limits = {}
    for name in GENERATORS:
        mine = held & np.array([r[2] == name for r in rows])
        cuts = [c for c in np.unique(z[mine]) if y[mine][z[mine] >= c].mean() >= precision]
        limits[name] = float(min(cuts, default=np.inf))
    return Trees(bias, trees, limits)


def scan(docs: DataFrame, trees: Trees | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and, by kind, ``email, ip, card, phone`` and ``mail, account, number array<struct<s,e,...>>``.

    The last three are what the trees select, where no base kind overlaps it. Of candidates of theirs that overlap they are
    taken in order of score, then place, each if it overlaps none that is taken. Places are code points, ends exclusive. Null texts count as empty; repeated
    rows are scanned alike; other columns are ignored; an empty table gives an empty one.
    """
    trees = trees or train(docs.sparkSession)
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = candidates(base_spans(df)).drop("text")
    taken = F.concat(*KINDS)

    def chosen(name: str) -> Column:
        scored = F.transform(clear_of(F.col(name), taken), lambda x: F.struct(x["s"], x["e"], trees.score(x["f"]).alias("z")))
        return F.filter(scored, lambda x: x["z"] >= trees.limits[name])

    df = df.withColumns({name: chosen(name) for name in MORE})

    def ranked(k: int) -> Column:
        return F.transform(MORE[k], lambda x: F.struct((-x["z"]).alias("o"), x["s"].alias("s"), x["e"].alias("e"), F.lit(k).alias("k")))

    def take(done: Column, x: Column) -> Column:
        return F.when(F.exists(done, lambda o: (o["s"] < x["e"]) & (x["s"] < o["e"])), done).otherwise(F.concat(done, F.array(x)))

    df = df.withColumn("_all", F.array_sort(F.concat(*map(ranked, range(len(MORE))))))
    df = df.withColumn("_all", F.when(F.size("_all") > 1, F.aggregate("_all", F.slice("_all", 1, 0), take)).otherwise(F.col("_all")))

    def of(k: int) -> Column:
        return F.array_sort(F.transform(F.filter("_all", lambda x: x["k"] == k), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), (-x["o"]).alias("z"))))

    return df.select("doc_id", *KINDS, *[of(k).alias(n) for k, n in enumerate(MORE)])


def digests(found: DataFrame) -> DataFrame:
    """The columns ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of a scan."""
    every = [*KINDS, *MORE]
    return found.select("doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS], F.sha2(listed(merged(KINDS), KINDS).cast("binary"), 256).alias("base_sha256"), listed(merged(every), every).alias("spans"))
