"""Spelling variants, URL filters and periodic runs against brute force and on odd tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigrain.llm import periodic, queries, urls, variants
from evigrain.runtime import table
from tests.llm.test_llm import DOCS, MIDDLE, SMALL


def brute_near(a, b):
    """Whether two words differ by exactly one inserted, deleted or replaced character."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, dominance=10):
    found = {}
    for w, n in counts.items():
        near = sorted((x for x in counts if brute_near(w, x)), key=lambda x: (-counts[x], x))
        form = near[0] if near and counts[near[0]] >= dominance * n else None
        found[w] = [n, len(near), form, form and counts[form]]
    for w in found:
        root = w
        while found[root][2] is not None:
            root = found[root][2]
        found[w].append(root)
    return {w: tuple(x) for w, x in found.items()}


def as_texts(spark, counts):
    """A text for each word, which holds it so often."""
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(sorted(counts.items()))]
    return spark.createDataFrame(rows, "doc_id long, text string")


def collected(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


@pytest.mark.parametrize(("limit", "hot"), [(64, 32768), (4, 32768), (3, 20)])
def test_variants_equal_all_pairs(spark, limit, hot):
    rng = random.Random(limit)
    stems = ["".join(rng.choice("abü") for _ in range(rng.randrange(7, 12))) for _ in range(40)]
    counts = {}
    for stem in stems:
        counts[stem] = rng.randrange(2, 400)
        for _ in range(6):
            at = rng.randrange(len(stem) + 1)
            made = rng.choice([stem[:at] + rng.choice("abü") + stem[at:], stem[:at] + stem[at + 1 :], stem[:at] + rng.choice("abü") + stem[at + 1 :]])
            if len(made) >= 7:
                counts.setdefault(made, rng.randrange(2, 30))
    found = collected(variants.variants(as_texts(spark, counts), limit=limit, hot_rows=hot, typos=0))
    assert found == brute_variants(counts)


def test_one_block_holds_all_words(spark):
    """All words share their first half, in one hot block, so the place of the edit is halved until few words are left."""
    rng = random.Random(5)
    counts = {"commonhalf" + "".join(rng.choice("abcde") for _ in range(10)): rng.randrange(2, 5) for _ in range(400)}
    counts |= {w[:14] + "z" + w[14:]: 2 for w in list(counts)[:50]} | {w[:-1] + "é": 60 for w in list(counts)[:50]}
    for limit, hot in ((8, 100), (1000, 32768)):
        assert collected(variants.variants(as_texts(spark, counts), limit=limit, hot_rows=hot, typos=0)) == brute_variants(counts)


def test_forms_are_followed_to_the_root(spark):
    counts = {"letters": 2000, "lettars": 200, "lettaro": 20, "lettauo": 2, "alone_is": 5, "another": 3}
    del counts["alone_is"]
    found = collected(variants.variants(as_texts(spark, counts), typos=0))
    assert found["lettauo"] == (2, 1, "lettaro", 20, "letters") and found["letters"] == (2000, 1, None, None, "letters") and found["another"][4] == "another"


def test_words_lose_characters_by_their_crc(spark):
    text = "Überlange Wörter und kurze, ZUSAMMEN zusammen×zusammen"
    own = Counter(w for i in range(200) for w in variants.spelled(str(i), text.encode()))
    expected = Counter()
    for i in range(200):
        for run in ("Überlange", "zusammen", "zusammen×zusammen"):
            h = zlib.crc32(f"{i}:{run}".encode())
            expected[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    assert own == Counter({w: n for w, n in expected.items() if len(w) >= 7})


def test_variants_on_odd_tables(spark):
    rows = [(1, "straßen straßen strassen"), (None, "straßen " * 30), (2, None), (2, ""), (2, "x" * 100_000 + " " + "x" * 100_000 + " " + "x" * 99_999 + " " + "x" * 99_999), (3, "12 !")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("mine")).withColumn("n", F.lit(0))
    found = collected(variants.variants(docs, typos=0))
    assert {len(w): x[:2] for w, x in found.items()} == {7: (32, 0), 100_000: (2, 1), 99_999: (2, 1)}
    assert variants.variants(docs.limit(0)).collect() == []


RULES = queries.URL_RULES


def brute_place(url):
    """(host, path) by walking through the URL."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i, c in enumerate(rest) if c in "/?#"), default=len(rest))
    path = rest[end:]
    stop = min((i for i, c in enumerate(path) if c in "?#"), default=len(path))
    return "".join(c.lower() if c.isascii() else c for c in rest[:end]), path[:stop]


def brute_rule(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


ODD_URLS = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.Org", "http://example.org/es/1?x=://", "x://a.example.org/en/17#q", "x://aexample.org/es/", "x://org/", "x://com/fr/\n2", "x://ä.COM/de/ü?", "x://b.com?/de/", "x://b.com/DE/", "x://example.org/es", "x://.org/y", "a://b://org/"]


@pytest.mark.parametrize("in_plan", [200, 0])
def test_places_and_rules(spark, in_plan):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(ODD_URLS)], "page_id long, url string").unionByName(table(spark, SMALL, "pages").select("page_id", "url"))
    for r in urls.matched(pages, RULES, in_plan=in_plan).collect():
        host, path = brute_place(r["url"])
        rule = brute_rule(host, path, RULES)
        assert (r["host"], r["path"], r["rule"], r["rule_verdict"]) == (host, path, rule and rule.name, rule and rule.verdict)


def brute_model(texts, least_share):
    """Dictionaries of context and gram counts, contexts as tuples of symbols before a place; only what is common enough."""
    contexts, grams = Counter(), Counter()
    for text in texts:
        own = [2, *text.encode().lower()]
        for at in range(1, len(own) + 1):
            symbol = own[at] if at < len(own) else "end"
            for k in range(min(urls.ORDER, at) + 1):
                contexts[tuple(own[at - k : at])] += 1
                grams[tuple(own[at - k : at]), symbol] += 1
    least = least_share * contexts[()]
    return {c: n for c, n in contexts.items() if n >= least}, {g: n for g, n in grams.items() if n >= least}


def brute_likelihood(model, text):
    contexts, grams = model
    left = defaultdict(float)
    for (context, _), n in grams.items():
        left[context] += (n - urls.DISCOUNT) / contexts[context]
    own, total = [2, *text.encode().lower()], 0.0
    for at in range(1, len(own) + 1):
        symbol, p = own[at] if at < len(own) else "end", 1 / 257
        for k in range(min(urls.ORDER, at) + 1):
            context = tuple(own[at - k : at])
            if context in contexts:
                n = grams.get((context, symbol), 0)
                p = max(n - urls.DISCOUNT, 0) / contexts[context] + (1 - left[context]) * p
        total += math.log(p)
    return total / len(own)


@pytest.mark.parametrize("least_share", [1e-5, 2e-3])
def test_ratios_equal_a_plain_model(spark, least_share):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(ODD_URLS * 2)], "page_id long, url string").unionByName(table(spark, SMALL, "pages").select("page_id", "url"))
    known = {"allow": [], "block": []}
    for r in pages.collect():
        rule = brute_rule(*brute_place(r["url"]), RULES)
        if rule and zlib.crc32(r["url"].encode()) % urls.CALIBRATION:
            known[rule.verdict].append(r["url"])
    models = {k: brute_model(v, least_share) for k, v in known.items()}
    for r in urls.judged(pages, RULES, least_share=least_share).collect():
        expected = brute_likelihood(models["allow"], r["url"] or "") - brute_likelihood(models["block"], r["url"] or "")
        assert r["ratio"] == pytest.approx(expected, abs=1e-9)
        rule = brute_rule(*brute_place(r["url"]), RULES)
        assert r["verdict"] == (rule.verdict if rule else "allow" if r["score"] >= 0.5 else "block")


def test_probabilities_of_a_context_sum_to_one():
    model = urls.chain(*_counts([b"http://ab.de/x", b"http://ab.de/y", b"http://abc.de"]))
    assert all(0 <= x <= 1 for x in model.leaves) and len(model.contexts) == len(set(model.contexts.tolist()))
    sums = np.bincount(np.searchsorted(model.contexts, model.grams | urls.WHOLE), model.shares, len(model.contexts)) + model.leaves
    assert sums == pytest.approx(np.ones(len(sums)))


def _counts(texts):
    keys = np.concatenate([k for _, c, g in urls._grams(texts) for k in (c, g)])
    return np.unique(keys, return_counts=True)


def test_ratio_tells_rejected_urls_from_accepted_ones(spark):
    """Rules see some hosts only; the models tell others of the same kinds apart, in spite of words that were never seen."""
    rng = random.Random(3)
    kinds = {"good": ["news", "museum", "school", "library"], "bad": ["casino", "pills", "betting", "lottery"]}
    rows, truth = [], {}
    for i in range(3000):
        kind = rng.choice(["good", "bad"])
        word = rng.choice(kinds[kind])
        zone = rng.choice(["org", "net"]) if kind == "good" else rng.choice(["biz", "net"])
        rows.append((i, f"http://{word}-{rng.randrange(500)}.{zone}/page/{rng.randrange(10_000)}"))
        truth[i] = "allow" if kind == "good" else "block"
    rules = (urls.Rule("org", "/", urls.ALLOW), urls.Rule("biz", "/", urls.BLOCK))
    found = urls.judged(spark.createDataFrame(rows, "page_id long, url string"), rules).filter("rule IS NULL").collect()
    assert len(found) > 1000 and sum(r["verdict"] == truth[r["page_id"]] for r in found) >= 0.97 * len(found)


def test_urls_on_odd_tables(spark):
    pages = spark.createDataFrame([(1, None), (None, "x://a.org/"), (1, "x://b.net/" + "y" * 100_000), (1, "x://b.net/")], "page_id long, url string").withColumn("host", F.lit("mine")).withColumn("rule", F.lit(1))
    found = urls.judged(pages, RULES).collect()
    assert [(r["page_id"], r["verdict"], r["ratio"]) for r in found] == [(1, "allow", None), (None, "allow", None), (1, "allow", None), (1, "allow", None)]
    assert urls.judged(pages.limit(0), RULES).collect() == []
    with_both = pages.unionByName(spark.createDataFrame([(5, "x://c.com/de/", "mine", 1)], pages.schema))
    assert all(r["ratio"] is not None for r in urls.judged(with_both, RULES, in_plan=0).collect())


def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 2):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and not any(all(words[k] == words[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("kinds", [1, 2, 3, 30])
def test_runs_equal_brute_force(kinds):
    rng = random.Random(kinds)
    for _ in range(400):
        n = rng.randrange(130)
        words = [rng.randrange(kinds) for _ in range(n)]
        for _ in range(rng.randrange(3)):
            a, p, n_turns = rng.randrange(n + 1), rng.randrange(1, 9), rng.randrange(2, 12)
            for i in range(a, min(n, a + p * n_turns)):
                words[i] = words[a + (i - a) % p]
        assert periodic.find(periodic.numbered(words)) == brute_runs(words)


def test_lag_counts_are_exact():
    rng = np.random.default_rng(2)
    own = np.minimum(rng.zipf(1.3, 3000), 900).astype(np.int32)
    own = np.unique(own, return_inverse=True)[1].astype(np.int32)
    counts = periodic.lag_counts(own, 750)
    assert all(counts[q] == int((own[q:] == own[:-q]).sum()) for q in range(1, 751))


def brute_op13(doc_id, text):
    words = [w for w in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, n_words, q in runs for i in range(s + q, s + n_words)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_op13_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()}
    found = queries.op13_periodic_runs(spark, SMALL).collect()
    assert len(found) == len(texts) and any(r["n_runs"] for r in found)
    for r in found:
        if len(texts[r["doc_id"]] or "") < 20_000:
            assert tuple(r)[1:] == brute_op13(r["doc_id"], texts[r["doc_id"]])


def test_runs_on_odd_tables(spark):
    rows = [(1, None, None), (None, "w " * 70_000, 1), (2, "", 2), (2, "a b a b a b a b", 3), (2, "a b a b a b a b", 3), (3, "y\x0bz\u00a0y" * 9, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs long")
    found = periodic.runs(docs).collect()
    assert [[tuple(x) for x in r["found"]["runs"]] for r in found] == [[], [(0, 70_000, 1)], [], [(0, 8, 2)], [(0, 8, 2)], [(1, 8, 1)]]
    assert found[3]["found"]["collapsed"] == "a b" and found[0]["found"]["collapsed"] == "" and found[1]["found"]["n_words"] == 70_000
    assert periodic.runs(docs.limit(0)).collect() == []
    planted = docs.select(periodic.planted(F.col("text")).alias("text")).collect()
    assert planted[1]["text"] == rows[1][1] and planted[0]["text"] is None
