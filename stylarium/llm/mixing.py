"""Mixing sources to target weights (operator 8), DataFrame functions only: soft membership and projected gradient.

Domains are the values of a labelled table. A naive Bayes model gives each
document scores for the domains, from five bucketed text features and from
the hashed words that tell the domains apart, counted on three quarters of at most SAMPLE_ROWS
hash-chosen labelled rows of each domain. As dependent words make such scores
too sure, a scale and a bias a domain are then fitted on the other quarter, by its likelihood with
every domain weighed as in all labels: so mean posteriors are the domains' shares.
Document rates r >= 0 then minimise

    1/2 sum_k (sum_d r_d n_d p_dk - T_k)^2 / T_k + ridge/2 sum_d n_d (r_d - 1)^2

for n_d tokens, posteriors p_dk and targets T_k. At the minimum a rate is 1 less
the document's share in a price for each domain, projected on r >= 0. Gradient
steps go over the prices, scaled by the Gram matrix of the posteriors of
documents with a positive rate; each takes one pass of sums over the table of
posteriors. They end when the gradient is under TOLERANCE, relative to the targets; if it
never is, that is an error.

Edge cases: null text has no tokens, but features and a rate like any other.
Null labels teach nothing; without labels there is one domain and all rates are
1. Repeated rows count each. A target for a domain that no label names
is an error; missing targets are 0, and weigh as LEAST of an even share. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, scratch

BUCKETS, SMOOTH, TEMPER, RIDGE = 6, 1.0, 0.8, 0.0001
STEPS, TOLERANCE, LEAST = 100, 1e-6, 1e-4
SLOTS, CLEAR, LEAST_ROWS = 1 << 16, 3.0, 3  # of word hashes; standard errors; labelled rows
KEPT_BACK, PULL = 4, 1.0  # one labelled row in so many calibrates; rows that the biases' squares weigh
SAMPLE_ROWS = 4000  # labelled rows of each domain that the classifier is fitted on, chosen by hash
FEATURES = ("f_length", "f_word", "f_upper", "f_odd", "f_lines")


def featured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row (its number, to be written before it is used), n_tokens, the bucketed features and slots, the hashes of the different words."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_count(t, F.lit(r"\S++"))
    slots = F.array_distinct(F.transform(F.split(F.lower(F.replace(t, F.lit("\n"), F.lit(" "))), " "), lambda w: F.pmod(F.xxhash64(w), F.lit(SLOTS)).cast("int")))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), words.cast("long").alias("n_tokens"), *_buckets(F.col(text_col)), slots.alias("slots")
    )


def _buckets(text: Column) -> list[Column]:
    t = F.coalesce(text, F.lit(""))
    n = F.length(t).cast("double")
    words = F.regexp_count(t, F.lit(r"\S++")).cast("double")
    bucket = lambda x: F.greatest(F.lit(0), F.least(F.lit(BUCKETS - 1), F.floor(x).cast("int")))
    share = lambda pattern: F.regexp_count(t, F.lit(pattern)) / F.greatest(n, F.lit(1.0))
    return [
        bucket(F.log2(n + 1) / 2 - 2).alias("f_length"),
        bucket((n / F.greatest(words, F.lit(1.0)) - 3) / 1.2).alias("f_word"),
        bucket(share("[A-Z]") * 40).alias("f_upper"),
        bucket(share(r"[^\p{L}\s]") * 30).alias("f_odd"),
        bucket(F.regexp_count(t, F.lit("\n")) / F.greatest(words / 40, F.lit(1.0)) * 2).alias("f_lines"),
    ]


def vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def word_weights(rows: DataFrame, own: DataFrame, size: dict[str, int]) -> DataFrame | None:
    """slot, w: log-likelihood of a word's presence by domain, of the slots that set some domain apart clearly.

    At most SLOTS rows whatever the input.
    """
    domains = sorted(size)
    total = sum(size.values())
    counts = rows.join(F.broadcast(own), "doc_id").select("domain", F.explode("slots").alias("slot")).groupBy("slot").pivot("domain", domains).count().na.fill(0)
    n = {d: F.col(f"`{d}`") for d in domains}
    every = sum(n.values(), F.lit(0))
    base = every / total

    def clear(d: str) -> Column:
        expected = base * size[d]
        return F.abs(n[d] - expected) >= CLEAR * F.sqrt(expected * (1 - base) + 0.25)

    told = F.lit(False)
    for d in domains:
        told = told | clear(d)
    # Absence is counted too: w is what presence adds to it.
    logs = []
    for d in domains:
        p = (n[d] + SMOOTH * base) / (size[d] + SMOOTH)
        logs.append(F.log(p / (1 - p)) - F.log(base / (1 - base)))
    return counts.where((every >= LEAST_ROWS) & (every < total) & told).select("slot", F.array(*logs).alias("w"))


def softmax(scores: Column) -> Column:
    def shares(x: Column) -> Column:
        e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
        return F.transform(F.array(e), lambda y: F.transform(y, lambda v: v / F.aggregate(y, F.lit(0.0), lambda a, z: a + z)))[0]

    return F.transform(F.array(scores), shares)[0]


def calibrated(scores: Column, scale: float, bias: list[float]) -> Column:
    """Posteriors of scores under a scale and a bias a domain."""
    return softmax(F.zip_with(scores, vector(bias), lambda s, b: s * scale + b))


def calibrate(rows: DataFrame, k: int, steps: int = 25) -> tuple[float, list[float], float]:
    """Scale, biases and log loss of the likeliest fit to labelled rows (s, y, w), at most SAMPLE_ROWS a domain; by Newton's method."""

    def sums(theta: list[float]) -> tuple[float, list[float], list[list[float]]]:
        p = calibrated(F.col("s"), theta[0], theta[1:])
        at = rows.select("s", "w", "y", p.alias("p")).withColumn("m", dot(F.col("p"), F.col("s")))
        w, m = F.col("w"), F.col("m")
        one = [F.col("p")[i] for i in range(k)]
        told = F.greatest(F.element_at("p", F.col("y") + 1), F.lit(1e-300))
        got = at.agg(
            F.sum(w).alias("w"),
            F.count("*").alias("n"),
            F.sum(-w * F.log(told)).alias("loss"),
            F.sum(w * (m - F.element_at("s", F.col("y") + 1))).alias("g0"),
            F.sum(w * (dot(F.col("p"), F.transform("s", lambda x: x * x)) - m * m)).alias("h0_0"),
            *[F.sum(w * (one[i] - (F.col("y") == i).cast("double"))).alias(f"g{i + 1}") for i in range(k)],
            *[F.sum(w * one[i] * (F.col("s")[i] - m)).alias(f"h0_{i + 1}") for i in range(k)],
            *[F.sum(w * one[i] * (float(i == j) - one[j])).alias(f"h{i + 1}_{j + 1}") for i in range(k) for j in range(i, k)],
        ).first()  # one row
        if not got["w"]:
            return 0.0, [0.0] * (k + 1), []
        bias, pull = [0.0, *theta[1:]], PULL / got["n"]
        loss = got["loss"] / got["w"] + pull / 2 * sum(b * b for b in bias)
        grad = [got[f"g{i}"] / got["w"] + pull * bias[i] for i in range(k + 1)]
        return loss, grad, [[got[f"h{min(i, j)}_{max(i, j)}"] / got["w"] + (pull if i == j else 0.0) for j in range(k + 1)] for i in range(k + 1)]

    theta = [1.0] + [0.0] * k
    loss, grad, curve = sums(theta)
    for _ in range(steps if curve else 0):
        if max(map(abs, grad)) < 1e-7:
            break
        move, part = solve(curve, grad), 1.0
        while True:
            new = [max(t - part * m, 1e-3) if i == 0 else t - part * m for i, (t, m) in enumerate(zip(theta, move, strict=True))]
            tried = sums(new)
            if tried[0] <= loss or part < 1e-3:
                break
            part /= 2
        theta, (loss, grad, curve) = new, tried
    return theta[0], theta[1:], loss


def posteriors(rows: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], DataFrame, dict]:
    """Domains, rows (doc_id, n_tokens) with p, the posterior, and a report of the rows kept back: log loss and mean posteriors."""
    named = labels.where("domain is not null and doc_id is not null").select("doc_id", "domain").distinct()
    share = {r["domain"]: r["count"] for r in named.groupBy("domain").count().collect()}  # one row a domain
    order = Window.partitionBy("domain").orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id")
    own = named.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample_rows).drop("r")
    back = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(KEPT_BACK)) == 0
    own = cut(own.withColumn("back", back), "labelled")
    taught = own.where("not back").drop("back")
    counts = (
        rows.join(F.broadcast(taught), "doc_id")  # at most sample_rows a domain
        .select("domain", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in FEATURES])).alias("x"))
        .groupBy("domain", "x.f", "x.b")
        .count()
        .orderBy("domain", "f", "b")
        .collect()  # domains x 5 features x BUCKETS
    )
    domains = sorted({r["domain"] for r in counts})
    if not domains:
        return ["all"], rows.select("doc_id", "n_tokens", F.array(F.lit(1.0)).alias("p")), {}
    size = {d: sum(r["count"] for r in counts if r["domain"] == d) // len(FEATURES) for d in domains}
    logs = {(r["domain"], r["f"], r["b"]): r["count"] for r in counts}
    total = sum(size.values())
    sums = []
    for d in domains:
        e = F.lit(math.log(size[d] / total))
        for f in FEATURES:
            row = [math.log((logs.get((d, f, b), 0) + SMOOTH) / (size[d] + SMOOTH * BUCKETS)) for b in range(BUCKETS)]
            e = e + F.get(vector(row), F.col(f))
        sums.append(e)
    weights = cut(word_weights(rows, taught, size), "weights")
    # Only words with a weight go on; a document's sum is made where its words are, and only that is shuffled.
    found = rows.select("row", F.explode("slots").alias("slot")).join(F.broadcast(weights), "slot")  # at most SLOTS rows
    added = found.groupBy("row").agg(*[F.sum(F.col("w")[i]).alias(f"w{i}") for i in range(len(domains))])
    scores = F.array(*[s + F.coalesce(F.col(f"w{i}"), F.lit(0.0)) for i, s in enumerate(sums)])
    scored = cut(rows.drop("slots").join(added, "row", "left").select("doc_id", "n_tokens", scores.alias("s")), "scores")
    y = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("domain")).cast("int") - 1
    kept = scored.join(F.broadcast(own.where("back")), "doc_id").select("s", y.alias("y"), "domain").where("y >= 0")
    there = {r["domain"]: r["count"] for r in kept.groupBy("domain").count().collect()}
    weigh = F.coalesce(*[F.when(F.col("domain") == d, float(share[d]) / n) for d, n in there.items()], F.lit(0.0))
    kept = cut(kept.withColumn("w", weigh), "kept-back").coalesce(1)  # bounded by sample_rows a domain
    scale, bias, loss = calibrate(kept, len(domains))
    p = calibrated(F.col("s"), scale, bias)
    means = kept.select("w", p.alias("p")).agg(*[(F.sum(F.col("w") * F.col("p")[i]) / F.sum("w")).alias(str(i)) for i in range(len(domains))]).first()
    labelled = sum(share[d] for d in there) or 1
    report = {"log_loss": loss, "scale": scale, "bias": bias, "mean_posterior": list(means), "label_share": [share[d] / labelled if d in there else 0.0 for d in domains]}
    return domains, scored.select("doc_id", "n_tokens", p.alias("p")), report


def solve(a: list[list[float]], b: list[float]) -> list[float]:
    """The solution of a small system by elimination with pivots."""
    n = len(b)
    rows = [[*r, x] for r, x in zip(a, b, strict=True)]
    for i in range(n):
        best = max(range(i, n), key=lambda j: abs(rows[j][i]))
        rows[i], rows[best] = rows[best], rows[i]
        for j in range(i + 1, n):
            f = rows[j][i] / rows[i][i]
            rows[j] = [x - f * y for x, y in zip(rows[j], rows[i], strict=True)]
    out = [0.0] * n
    for i in reversed(range(n)):
        out[i] = (rows[i][n] - sum(rows[i][j] * out[j] for j in range(i + 1, n))) / rows[i][i]
    return out


def rate(p: Column, prices: list[float]) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - dot(p, vector(prices)))


def fit(table: DataFrame, goal: list[float], ridge: float, tolerance: float, steps: int) -> tuple[list[float], list[float], int]:
    """Prices, totals and the steps taken, for a table of (p, n)."""
    k = len(goal)
    floor = LEAST * (sum(goal) or 1.0) / k
    scale = [max(g, floor) for g in goal]

    def sums(prices: list[float]) -> tuple[list[float], list[list[float]]]:
        r = rate(F.col("p"), prices)
        n = F.col("n").cast("double")
        live = F.when(r > 0, n).otherwise(0.0)
        total = [F.sum(r * n * F.col("p")[i]).alias(f"t{i}") for i in range(k)]
        gram = [F.sum(live * F.col("p")[i] * F.col("p")[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
        got = table.agg(*total, *gram).first()  # one row
        g = [[float(got[f"g{min(i, j)}_{max(i, j)}"] or 0) for j in range(k)] for i in range(k)]
        return [float(got[f"t{i}"] or 0) for i in range(k)], g

    def gradient(prices: list[float], total: list[float]) -> list[float]:
        return [ridge * x - (t - g) / s for x, t, g, s in zip(prices, total, goal, scale, strict=True)]

    size = lambda v: max(abs(x) for x in v)
    prices = [0.0] * k
    total, gram = sums(prices)
    error = gradient(prices, total)
    for step in range(steps):
        if size(error) <= tolerance:
            return prices, total, step
        scaled = [[(ridge if i == j else 0.0) + gram[i][j] / scale[i] for j in range(k)] for i in range(k)]
        move = solve(scaled, error)
        part = 1.0
        while True:
            new = [x - part * m for x, m in zip(prices, move, strict=True)]
            at, its = sums(new)
            left = gradient(new, at)
            if size(left) < size(error) or part < 1e-3:
                break
            part /= 2
        prices, total, gram, error = new, at, its, left
    if size(error) <= tolerance:
        return prices, total, steps
    raise RuntimeError(f"mixing: the gradient is {size(error):.2g} after {steps} steps, over {tolerance:.2g}")


def mix(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float] | None = None,
    ridge: float = RIDGE,
    tolerance: float = TOLERANCE,
    steps: int = STEPS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, dict]:
    """(doc_id, n_tokens, domain, posterior, rate, target, achieved) per row, and a report of totals, targets and steps.

    target and achieved are the token totals of the row's own domain. labels: doc_id, domain. targets: weight by
    domain; by default each domain's expected share to the power TEMPER, which evens them out somewhat.
    """
    with scratch(docs.sparkSession):
        rows = cut(featured(docs, id_col, text_col), "features")
        domains, scored, quality = posteriors(rows, labels)
        scored = cut(scored, "posteriors", keep=True)
    table = scored.select("p", F.col("n_tokens").alias("n"))
    now = [float(x or 0) for x in table.agg(*[F.sum(F.col("n") * F.col("p")[i]) for i in range(len(domains))]).first()]
    size = sum(now) or 1.0
    if targets is None:
        weight = {d: (x / size) ** TEMPER if x > 0 else 0.0 for d, x in zip(domains, now, strict=True)}
    else:
        if unknown := set(targets) - set(domains):
            raise ValueError(f"targets for unknown domains: {sorted(unknown)}")
        weight = {d: float(targets.get(d, 0)) for d in domains}
    whole = sum(weight.values()) or 1.0
    goal = [size * weight[d] / whole for d in domains]
    prices, after, taken = fit(table, goal, ridge, tolerance, steps)
    report = {"domains": domains, "targets": goal, "before": now, "after": after, "prices": prices, "steps": taken, "classifier": quality}
    at = F.array_position("p", F.array_max("p")).cast("int") - 1
    text_of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), at)
    out = scored.select(
        "doc_id",
        "n_tokens",
        text_of(domains).alias("domain"),
        F.col("p").alias("posterior"),
        rate(F.col("p"), prices).alias("rate"),
        text_of(goal).alias("target"),
        text_of(after).alias("achieved"),
    )
    return out, report


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id, domain of the labels table: its quality and toxic marks together."""
    return labels.where("quality is not null and toxic is not null").select(
        "doc_id", F.concat(F.lit("quality"), "quality", F.lit("_toxic"), "toxic").alias("domain")
    )


def resample(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each row floor(rate) times, and once more with the chance of the rest, drawn from a hash of its id.

    mixed: doc_id, rate of the same docs. Rows of one doc_id have its greatest rate; rows of null doc_id stay as they are.
    """
    rates = mixed.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max("rate").alias("__rate"))
    packed = docs.select(F.struct("*").alias("__row"), F.col(id_col).cast("long").alias("__key"))
    both = packed.join(rates.hint("merge"), F.col("__key") == F.col("__id"), "left")
    draw = F.pmod(F.xxhash64("__key", F.lit(8)), F.lit(1 << 20)) / float(1 << 20)
    copies = F.floor(F.coalesce("__rate", F.lit(1.0)) + draw).cast("int")
    return both.select("__row", F.explode(F.array_repeat(F.lit(1), copies)).alias("__copy")).select("__row.*")
