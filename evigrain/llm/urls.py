"""URL filters: allow and block rules, and a character language-model ratio for URLs that no rule fits.

Two variable-order Markov models over the bytes of lower-cased URLs, one of
accepted and one of rejected URLs, are counted over all URLs that rules decide.
A context stays if it makes up a share LEAST_SHARE of its model's places, so a
model has no more contexts than ORDER / LEAST_SHARE, whatever was read; a place
is predicted by the longest context that stayed, with absolute discounts, and
what they leave goes to the next shorter one, in the end to all bytes alike.
Places where a URL starts and ends are symbols of their own. The difference of
both log-likelihoods per symbol is judged by a logistic curve through
one URL in CALIBRATION that no model has counted; their differences are gathered
in steps of STEP.

Defined cases: a URL that is null or has no "://" has an empty host and path, and
no rule fits it; null is judged as an empty URL. Without URLs of both kinds
among those that rules decide, every other URL is allowed with a null ratio. Equal
URLs count each. An empty table gives an empty result. Extra columns are carried
along.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigrain.llm.samples import calibrated
from evigrain.runtime import stored, tuned

ALLOW, BLOCK = "allow", "block"
#: Characters before a place that its context can have.
ORDER = 6
LEAST_SHARE = 1e-5
DISCOUNT = 0.75
CALIBRATION = 10
#: Width of the steps in which ratios are gathered for the curve, and the largest ratio told apart.
STEP, FARTHEST = 0.002, 20.0
#: Rules up to which they become one expression; beyond it they are joined by host.
RULES_IN_PLAN = 200

#: Different grams of one kind that a task counts before it hands them on.
COUNTED_GRAMS = 1 << 20

#: Symbols are bytes and the end of a URL. A key has nine bits for the symbol, eight for each byte of the context, and the context's length above; WHOLE in place of a symbol counts the context itself.
END, SYMBOLS, WHOLE = 256, 257, 511


class Rule(NamedTuple):
    """What begins with this path on this host or one of its subdomains gets the verdict."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parsed(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """pages with host (ASCII-lowered) and path."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^[^?#]*", 0)
    return pages.withColumn("host", F.translate(host, upper, upper.lower())).withColumn("path", path)


def _in_plan(places: DataFrame, rules: list[Rule]) -> DataFrame:
    found = F.lit(None)
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == rule.host) | F.endswith("host", F.lit("." + rule.host))) & F.startswith("path", F.lit(rule.path))
        found = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return places.withColumn("_fit", found.cast("struct<rule:string,verdict:string>"))


def _joined(places: DataFrame, rules: list[Rule]) -> DataFrame:
    """For many rules: each host and path once, with the hosts above it, meets the rules of these hosts with a path of one of their lengths."""
    spark = places.sparkSession
    listed = spark.createDataFrame(rules, "rule_host string, rule_path string, verdict string")
    lengths = listed.groupBy("rule_host").agg(F.collect_set(F.char_length("rule_path")).alias("lengths"))
    distinct = places.select("host", "path").distinct()
    parts = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hosts = distinct.withColumn("rule_host", F.explode(above)).join(lengths, "rule_host")
    starts = hosts.select("host", "path", "rule_host", F.explode("lengths").alias("n")).select("host", "path", "rule_host", F.substring(F.col("path"), F.lit(1), F.col("n")).alias("rule_path"))
    fits = starts.join(listed, ["rule_host", "rule_path"])
    best = fits.groupBy("host", "path").agg(F.max(F.struct((F.char_length("rule_host") + F.char_length("rule_path")).alias("n"), F.concat("rule_host", "rule_path").alias("rule"), "verdict")).alias("best"))
    return places.join(stored(best, "url-rules").df, ["host", "path"], "left").withColumn("_fit", F.when(F.col("best").isNotNull(), F.struct("best.rule", "best.verdict"))).drop("best")


def matched(pages: DataFrame, rules: Iterable[Rule], url_col: str = "url", in_plan: int = RULES_IN_PLAN) -> DataFrame:
    """pages with host, path, rule and rule_verdict of the longest rule that fits, null if none does."""
    own = list(rules)
    names = [r.name for r in own]
    if len(set(names)) < len(names):
        raise ValueError("rules: each host and path once")
    places = parsed(pages, url_col)
    fits = _in_plan(places, own) if len(own) <= in_plan else _joined(places, own)
    return fits.withColumn("rule", F.col("_fit.rule")).withColumn("rule_verdict", F.col("_fit.verdict")).drop("_fit")


def _places(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all URLs one after the other, each between a start and an end: the bytes, the symbols (the end is 256), and how many bytes of its URL stand before each."""
    own = np.frombuffer(b"".join(b"\x02" + u.lower() + b"\x03" for u in urls), np.uint8).astype(np.int64)
    size = np.fromiter(map(len, urls), np.int64, len(urls)) + 2
    ends = np.cumsum(size)
    predicted = own.copy()
    predicted[ends - 1] = END
    return own, predicted, np.arange(len(own)) - np.repeat(ends - size, size)


def _grams(urls: list[bytes], order: int = ORDER) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each context length: the places that have such a context, its key, and the key of it with the symbol at the place."""
    own, predicted, before = _places(urls)
    at, context = np.flatnonzero(before > 0), np.zeros(len(own), np.int64)
    for k in range(order + 1):
        if k:
            at = at[before[at] >= k]
            context[at] |= own[at - k] << 8 * (k - 1)
        base = np.int64(k) << 57 | context[at] << 9
        yield at, base | WHOLE, base | predicted[at]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(accepted, key, n) of rows (accepted, url); counts of a task are merged while they are few."""
    held: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {True: [], False: []}

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(place, np.concatenate([n for _, n in parts])).astype(np.int64)

    def handed(kind: bool) -> pa.RecordBatch:
        keys, n = merged(held[kind])
        held[kind] = []
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(keys), pa.bool_()), pa.array(keys), pa.array(n)], names=["accepted", "key", "n"])

    for batch in batches:
        accepted, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for kind in held:
            own = [u for u, a in zip(urls, accepted, strict=True) if a == kind]
            if not own:
                continue
            for _, contexts, grams in _grams(own):
                held[kind] += [np.unique(contexts, return_counts=True), np.unique(grams, return_counts=True)]
            held[kind] = [merged(held[kind])]
            if len(held[kind][0][0]) > COUNTED_GRAMS:
                yield handed(kind)
    for kind in held:
        if held[kind]:
            yield handed(kind)


class Chain(NamedTuple):
    """A model: contexts that stayed with the share that they leave to shorter ones, and grams with their own share; keys are sorted."""

    contexts: np.ndarray
    leaves: np.ndarray
    grams: np.ndarray
    shares: np.ndarray


class Model(NamedTuple):
    accepted: Chain
    rejected: Chain
    slope: float
    offset: float


def chain(keys: np.ndarray, n: np.ndarray) -> Chain:
    """From the counts that stayed, in the order of their keys."""
    whole = (keys & WHOLE) == WHOLE
    contexts, total = keys[whole], n[whole].astype(float)
    grams, places = keys[~whole], np.searchsorted(contexts, keys[~whole] | WHOLE)
    taken = (n[~whole] - DISCOUNT) / total[places]
    return Chain(contexts, 1 - np.bincount(places, taken, len(contexts)), grams, taken)


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted keys among sorted ones, and which of them are there."""
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return place, keys[place] == wanted


def log_likelihoods(own: Chain, urls: list[bytes]) -> np.ndarray:
    """Mean log-likelihood of each URL's symbols, its end included."""
    likely = np.full(sum(map(len, urls)) + 2 * len(urls), 1 / SYMBOLS)
    for at, contexts, grams in _grams(urls):
        place, known = _at(own.contexts, contexts)
        at, place, grams = at[known], place[known], grams[known]
        here, seen = _at(own.grams, grams)
        likely[at] = np.where(seen, own.shares[here], 0.0) + own.leaves[place] * likely[at]
    size = np.fromiter(map(len, urls), np.int64, len(urls)) + 2
    likely[np.cumsum(size) - size] = 1.0  # the start is given
    return np.add.reduceat(np.log(likely), np.cumsum(size) - size) / (size - 1) if len(urls) else np.zeros(0)


def ratios(model: Model, urls: list[bytes]) -> np.ndarray:
    """Difference of both mean log-likelihoods; above 0: likelier accepted."""
    return log_likelihoods(model.accepted, urls) - log_likelihoods(model.rejected, urls)


def _ratio(spark, model: Model, url: Column) -> Column:
    shared = spark.sparkContext.broadcast(tuple(model))

    @F.arrow_udf(T.DoubleType())
    def judged(urls: pa.Array) -> pa.Array:
        accepted, rejected, slope, offset = shared.value
        return pa.array(ratios(Model(Chain(*accepted), Chain(*rejected), slope, offset), urls.cast(pa.large_binary()).to_pylist()))

    return judged(F.coalesce(url, F.lit("")))


def fit(ruled: DataFrame, url_col: str = "url", least_share: float = LEAST_SHARE) -> Model | None:
    """A model from the URLs that rules decide (column rule_verdict); None without URLs of both kinds."""
    spark = tuned(ruled.sparkSession)
    labelled = ruled.filter("rule_verdict IS NOT NULL").select((F.col("rule_verdict") == ALLOW).alias("accepted"), F.coalesce(url_col, F.lit("")).alias("url"))
    later = F.crc32(F.encode("url", "UTF-8")) % CALIBRATION == 0
    counted = labelled.filter(~later).select("accepted", F.encode("url", "UTF-8").alias("url")).mapInArrow(_count, "accepted boolean, key long, n long")
    counts = stored(counted.groupBy("accepted", "key").agg(F.sum("n").alias("n")), "url-counts").df
    totals = {r["accepted"]: r["n"] for r in counts.filter(F.col("key") == WHOLE).collect()}  # the empty context: two rows at most
    if len(totals) < 2:
        return None
    chains = []
    for kind in (True, False):
        kept = counts.filter((F.col("accepted") == kind) & (F.col("n") >= least_share * totals[kind])).select("key", "n").toArrow()  # (ORDER + 1) * 2 / least_share rows at most
        keys, n = (kept.column(c).to_numpy() for c in ("key", "n"))
        order = np.argsort(keys)
        chains.append(chain(keys[order], n[order]))
    model = Model(*chains, 1.0, 0.0)
    step = F.round(F.greatest(F.lit(-FARTHEST), F.least(F.lit(FARTHEST), _ratio(spark, model, F.col("url")))) / STEP)
    steps = labelled.filter(later).select("accepted", step.alias("step")).groupBy("accepted", "step").count().collect()  # 2 * (2 * FARTHEST / STEP + 1) rows at most
    if len({r["accepted"] for r in steps}) < 2:
        return model
    raw, good, weight = (np.array([r[c] for r in steps], float) for c in ("step", "accepted", "count"))
    return Model(*chains, *calibrated(raw * STEP, good, weights=weight))


def judged(pages: DataFrame, rules: Iterable[Rule], url_col: str = "url", least_share: float = LEAST_SHARE, in_plan: int = RULES_IN_PLAN) -> DataFrame:
    """pages with host, path, rule, ratio and verdict: that of the longest rule that fits, else what the models say.

    score is the curve's share of accepted URLs at this ratio; from a half on a URL is allowed.
    """
    ruled = matched(pages, rules, url_col, in_plan)
    model = fit(ruled, url_col, least_share)
    if model is None:
        return ruled.withColumn("ratio", F.lit(None).cast("double")).withColumn("score", F.lit(None).cast("double")).withColumn("verdict", F.coalesce("rule_verdict", F.lit(ALLOW))).drop("rule_verdict")
    scored = ruled.withColumn("ratio", _ratio(pages.sparkSession, model, F.col(url_col)))
    scored = scored.withColumn("score", 1 / (1 + F.exp(-(model.slope * F.col("ratio") + model.offset))))
    return scored.withColumn("verdict", F.coalesce("rule_verdict", F.when(F.col("score") >= 0.5, ALLOW).otherwise(BLOCK))).drop("rule_verdict")
