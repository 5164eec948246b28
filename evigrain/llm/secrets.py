"""Secret scan: patterns find candidates, a random forest removes false findings.

Scan and scoring are DataFrame expressions only. Candidates are long runs of
token characters, and values of any length and any characters where something
that is called a password, token, key or the like is named, assigned or part of
an address. Their measures are length, kinds of characters and transitions,
dictionary coverage, and marks of the path and of neighbouring words. The forest
is grown in numpy on the driver, from labelled findings of a fixed number (a
parameter), and applied as one expression over the measures.

Labelled findings are made here, by rule: no labelled ones are public.

Defined cases: a null text has no candidates; a null path has no marks; each
occurrence is a row, so repeated rows and tokens repeat; runs inside a value are
not candidates of their own; an empty table gives an empty result. Extra columns
are dropped, but for the id and the path.
"""

from __future__ import annotations

import json
import random
import string
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHORTEST = 16
TREES, DEPTH, LEAST_LEAF = 15, 6, 8
#: Labelled findings that the forest is grown from.
TRAINING_ROWS = 6000
THRESHOLD = 0.5

# Words and marks that tell about a candidate.
WORDS = ("about account action after again array async back base block body branch build button cache call class click client close code color column commit common config content context control count current data date default delete detail device document domain edit element email entry error event example field file filter find first font format frame function global group handle header height hidden history home html http icon image import index info input insert item label language last layout length level library line link list load local location lock login main manager map master menu message meta method mode model module name native network node note null number object offset open option order output package page panel param parent path plugin point port post print private process product profile project property public query random range read record release remove render report request reset resource response result return root route sample schema screen script search section select send server service session set settings share show size sort source stack start state static status step stop storage store string style submit system table target task template test text theme time title token total track type unit update upload user util value vector version video view web width window work world write").split()
SECRET_WORDS = ("password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "api_key", "api-key", "access_key", "credential", "credentials", "auth", "bearer", "private_key", "client_secret")
PLAIN_WORDS = ("commit", "sha", "sha1", "sha256", "md5", "hash", "checksum", "digest", "integrity", "uuid", "guid", "etag", "revision", "version", "id", "build", "example", "placeholder", "sample", "dummy")
TEST_PATHS = ("test", "spec", "example", "sample", "fixture", "mock", "docs", "demo")
SETTING_PATHS = (".env", "config", "settings", "credentials", "secret", ".yml", ".yaml", ".ini", ".properties")
BIGRAMS = ("th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce").split()

_WORD = r"[^\x20\x09-\x0D]+"
_NAME = rf"(?i)(?:{'|'.join(SECRET_WORDS)})"
_NAMED = rf"{_NAME}s?[\"'`\])]*(?:[:=]+>?)?[\"'`]*$"
_ASSIGN = r"^(?:[:=]+>?|is|was)$"
_IN_WORD = rf"{_NAME}[\"'`\])]*[:=]+>?[\"'`]*(.+)$"
_IN_ADDRESS = r"://[^:/@]*:(.+)@"
_QUOTED = r"(?:^|[:=>(\[{])([\"'`])(.+?)\1"
_WRAPPED = r"^[\"'`(\[{<]+|[\"'`)\]}>,;.:!?]+$"
_RUN = rf"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{{{SHORTEST},}}+"

FEATURES = ("length", "digits", "uppers", "symbols", "letter_digit", "case_changes", "kinds", "bigrams", "vowels", "distinct", "dictionary", "hex", "uuid", "known_prefix", "placeholder", "quoted", "assigned", "value", "secret_near", "plain_near", "test_path", "setting_path")


def _any(value: Column, marks: tuple[str, ...]) -> Column:
    return value.rlike("|".join(m.replace(".", r"\.") for m in marks))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(id, path, word_no, word, before, after, candidate): a row for each long run of token characters and each value of something secret by name."""
    telling = F.col(text_col).rlike(rf"{_RUN}|{_IN_ADDRESS}|{_NAME}")
    found = docs.filter(telling).select(F.col(id_col), F.coalesce(F.lower(F.col(path_col).cast("string")), F.lit("")).alias("path"), F.regexp_extract_all(text_col, F.lit(_WORD), F.lit(0)).alias("words"))
    at = lambda i, by: F.coalesce(F.get("words", i + by), F.lit(""))
    worth = lambda i: at(i, 0).rlike(rf"{_RUN}|{_IN_WORD}|{_IN_ADDRESS}") | at(i, -1).rlike(_NAMED) | (at(i, -1).rlike(_ASSIGN) & at(i, -2).rlike(_NAMED))
    low = lambda i, by: F.lower(at(i, by))
    of = lambda i: F.struct(i.cast("long").alias("word_no"), at(i, 0).alias("word"), F.concat_ws(" ", low(i, -3), low(i, -2), low(i, -1)).alias("before"), low(i, 1).alias("after"))
    around = found.select(id_col, "path", F.inline(F.transform(F.filter(F.sequence(F.lit(0), F.size("words") - 1), worth), of)))
    follows = F.col("before").rlike(rf"{_NAMED}|{_NAMED[:-1]} (?:[:=]+>?|is|was)$")
    inside, address = F.regexp_extract("word", _IN_WORD, 1), F.regexp_extract("word", _IN_ADDRESS, 1)
    quoted = F.regexp_extract("word", _QUOTED, 2)
    value = F.when(address != "", address).when((quoted != "") & (follows | (inside != "")), quoted).when(inside != "", inside).when(follows, F.col("word")).otherwise("")
    split = around.withColumn("value", F.regexp_replace(value, _WRAPPED, "")).withColumn("runs", F.regexp_extract_all("word", F.lit(_RUN), F.lit(0)))
    every = F.concat(F.filter(F.array("value"), lambda v: v.rlike("[A-Za-z0-9]")), F.filter("runs", lambda r: ~F.contains(F.col("value"), r)))
    return split.withColumn("candidate", F.explode(every)).drop("value", "runs")


def measured(found: DataFrame) -> DataFrame:
    """found with the columns of FEATURES, all doubles."""
    c, low = F.col("candidate"), F.lower("candidate")
    size = F.char_length(c).cast("double")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / size
    head = F.lower(F.call_function("substring_index", F.col("word"), F.col("candidate"), F.lit(1)))
    context = F.concat_ws(" ", "before", head)
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    words = "|".join(sorted((w for w in WORDS if len(w) > 3), key=len, reverse=True))
    columns = {
        "length": size,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "symbols": share("[^A-Za-z0-9]"),
        "kinds": sum((c.rlike(kind).cast("double") for kind in ("[A-Z]", "[0-9]", "[^A-Za-z0-9]")), c.rlike("[a-z]").cast("double")),
        "vowels": F.regexp_count(low, F.lit("[aeiou]")) / F.greatest(F.regexp_count(low, F.lit("[a-z]")).cast("double"), F.lit(1.0)),
        "letter_digit": share("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])"),
        "case_changes": share("[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "bigrams": F.regexp_count(low, F.lit(f"(?={'|'.join(BIGRAMS)})")) / size,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(size, F.lit(40.0)),
        "dictionary": 1.0 - F.char_length(F.regexp_replace(low, words, "")) / size,
        "hex": flag(c.rlike("^[0-9a-fA-F]+$")),
        "uuid": flag(low.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")),
        "known_prefix": flag(c.rlike("^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{30,}|^xox[baprs]-|^AIza[A-Za-z0-9_-]{30,}|^sk_live_")),
        "placeholder": flag(low.rlike(r"^[<$%{*.xX0-]|example|change|your|placeholder|dummy|sample|^(null|none|nil|true|false|string|required|optional|undefined|empty)$|[(\[]|^.{0,2}$|\.env")),
        "value": flag(context.rlike(rf"{_NAMED}|{_NAMED[:-1]} (?:[:=]+>?|is|was)[\"'` ]*$") | head.rlike("://[^@]*:$")),
        "quoted": flag(F.col("word").rlike("[\"'`]")),
        "assigned": flag(head.rlike("[=:][\"'`]*$") | F.col("before").rlike("[=:]>?$")),
        "secret_near": flag(_any(context, SECRET_WORDS)),
        "plain_near": flag(context.rlike(rf"(^|[^a-z0-9])({'|'.join(PLAIN_WORDS)})([^a-z0-9]|$)")),
        "test_path": flag(_any(F.col("path"), TEST_PATHS)),
        "setting_path": flag(_any(F.col("path"), SETTING_PATHS)),
    }
    return found.withColumns({k: v.cast("double") for k, v in columns.items()})


def labelled_findings(rows: int = TRAINING_ROWS, seed: int = 11) -> list[dict]:
    """Findings with labels, by rule: keys of known forms and random secrets near telling words; digests, ids, names and placeholders."""
    rng = random.Random(seed)
    chars = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    mixed, hexes, names = string.ascii_letters + string.digits, "0123456789abcdef", [w for w in WORDS if len(w) > 3]
    code, settings = ("src/app/main.py", "lib/client.ts", "src0", "server.go", "notes.md", ""), (".env", "config/settings.yml", "deploy/credentials.ini")
    tests = ("tests/fixture.json", "docs/example.md", "spec/mock_data.rb")
    prose = lambda: " ".join(rng.choices(names, k=3))

    marks = "!#$%&*+-.:?@^_~"
    syllables = [a + b for a in "bdfghklmnprstvwz" for b in "aeiou"] + [*BIGRAMS, "ung", "keit", "heit", "tion", "sch", "ment", "ing", "able"]
    short = lambda: rng.choice(
        (
            lambda: chars(mixed + marks, rng.randint(6, 18)),
            lambda: rng.choice(names).capitalize() + chars(string.digits, rng.randint(1, 4)) + chars(marks, rng.randint(0, 2)),
            lambda: chars(string.ascii_lowercase, rng.randint(7, 14)),
            lambda: rng.choice("-_.").join(rng.choices(names, k=rng.randint(3, 5))) + rng.choice(("", chars(string.digits, 2))),
            lambda: rng.choice(names).translate(str.maketrans("aeios", "43105")) + chars(string.digits + marks, rng.randint(1, 4)),
            lambda: chars(string.digits, rng.randint(4, 10)),
            lambda: chars(string.ascii_letters, rng.randint(10, 40)),
        )
    )()

    def named(value: str, sure: bool) -> tuple[str, str]:
        """What stands before a value, and the word that it is in."""
        name, form = rng.choice(SECRET_WORDS), rng.randrange(5 if sure else 6)
        name = rng.choice((name, name.upper(), f"db_{name}", f"my{name.capitalize()}"))
        if form == 0:
            return prose(), f"{name}{rng.choice(('=', ':', '=>'))}{value}"
        if form == 1:
            return prose(), f"{name}={rng.choice(chr(34) + chr(39))}{value}"
        if form == 2:
            return f"{rng.choice(names)} {name} {rng.choice(('=', ':'))}", rng.choice(("{}", '"{}"', "'{}',")).format(value)
        if form == 3:
            return f"{rng.choice(names)} {rng.choice(names)} {name}:", rng.choice(("{}", '"{}"', "{}.")).format(value)
        if form == 4:
            return f"{rng.choice(('the', 'my', 'your'))} {name} is", rng.choice(("{}", '"{}"', "{}.")).format(value)
        return f"{rng.choice(names)} {rng.choice(('the', 'a', 'this'))} {name}", value

    def secret() -> dict:
        kind = rng.randrange(9)
        if kind == 0:
            value, before, word = rng.choice(("AKIA", "ASIA")) + chars(string.ascii_uppercase + string.digits, 16), prose(), "{}"
        elif kind == 1:
            value, before, word = chars(hexes, 40), f"{rng.choice(names)} {rng.choice(SECRET_WORDS)} {rng.choice('=:')}", '"{}"'
        elif kind == 2:
            value, before, word = chars(hexes, rng.randint(16, 32)), prose(), rng.choice(SECRET_WORDS) + rng.choice("=:") + "{}"
        elif kind == 3:
            value, before, word = chars(mixed + "+/", rng.randint(24, 64)), f"{rng.choice(names)} {rng.choice(SECRET_WORDS)} {rng.choice('=:')}", rng.choice(('"{}"', "{}"))
        elif kind == 4:
            value, before, word = rng.choice(("ghp_", "xoxb-", "AIza", "sk_live_")) + chars(mixed, 36), prose(), rng.choice(('"{}"', "{}", "key={}"))
        elif kind == 5:
            value, before, word = chars(mixed, rng.randint(16, 40)), f"{rng.choice(names)} authorization: bearer", "{}"
        elif kind == 6:
            value, before, word = short().replace("@", "!"), prose(), f"{rng.choice(('postgres', 'https', 'amqp'))}://{rng.choice(names)}:{{}}@{rng.choice(names)}.example"
        else:
            value = short()
            before, own = named(value, True)
            return {"candidate": value, "word": own, "before": before.lower(), "path": rng.choice(code + settings), "y": 1}
        return {"candidate": value, "word": word.format(value), "before": before, "path": rng.choice(code + settings), "y": 1}

    def plain() -> dict:
        kind, path = rng.randrange(13), rng.choice(code + tests)
        if kind == 0:
            value, before, word = chars(hexes, 40), f"{rng.choice(names)} {rng.choice(PLAIN_WORDS)}", rng.choice(("{}", "{}.", "({})"))
        elif kind == 1:
            value, before, word = str(uuid.UUID(int=rng.getrandbits(128), version=4)), rng.choice((prose(), "request id =", "token id:")), rng.choice(("{}", '"{}"', "id={}"))
        elif kind == 2:
            value, before, word = chars(hexes, rng.choice((32, 64))), prose(), rng.choice(PLAIN_WORDS[:9]) + rng.choice(":=-") + "{}"
        elif kind == 3:
            value = rng.choice("-_/").join(rng.choices(names, k=rng.randint(3, 6))) + rng.choice(("-", "_", "")) + rng.choice(("", str(rng.randint(1, 2030))))
            before, word = prose(), rng.choice(("{}", '"{}"', "{}.html"))
        elif kind == 4:
            value = "".join(w.capitalize() for w in rng.choices(names, k=rng.randint(3, 6))) + rng.choice(("", str(rng.randint(1, 64))))
            before, word = prose(), rng.choice(("{}", "{}()", '"{}"'))
        elif kind == 5:
            value = rng.choice(("x" * rng.randint(3, 30), "your-api-key-here-" + str(rng.randint(1, 99)), "1234567890123456", "0" * rng.randint(4, 40), "changeme", "<password>", "${DB_PASSWORD}", "{{token}}", "****", "example-" + rng.choice(names), "os.environ[", "getenv(", "$PASSWORD", "...", "-", "%s"))
            before, word = f"{rng.choice(names)} {rng.choice(SECRET_WORDS)} {rng.choice('=:')}", rng.choice(("{}", '"{}"'))
        elif kind == 6:
            value, before, word = "2024-" + "-".join(f"{rng.randint(1, 59):02d}" for _ in range(5)), prose(), "{}"
        elif kind == 7:
            value = "".join(rng.choices([w for w in names if len(w) < 8], k=rng.randint(3, 5)))
            before, word = prose(), rng.choice(("{}", "{},", "{}."))
        elif kind in (11, 12):
            value = "".join(rng.choices(syllables, k=rng.randint(6, 12)))[:30].ljust(16, "e")
            before, word = rng.choice((prose(), "".join(rng.choices(syllables, k=3)))), rng.choice(("{}", "{},", "{}.", "({})"))
            value = rng.choice((value, value.capitalize()))
        elif kind in (8, 9):
            value = rng.choice((*names, "the", "of", "and", "to", "for", "is", "was", "in", "a", "that", "not", "be", "must", "should", "has"))
            before, own = f"{rng.choice(names)} {rng.choice(('the', 'a', 'your', 'this'))} {rng.choice(SECRET_WORDS)}", rng.choice(("{}", "{},", "{}.")).format(value)
            return {"candidate": value, "word": own, "before": before, "path": path, "y": 0}
        else:
            value = rng.choice(("null", "none", "true", "false", "string", "required", "optional", "str", "undefined", "varchar(255)", *names))
            before, own = named(value, False)
            return {"candidate": value, "word": own, "before": before.lower(), "path": path, "y": 0}
        return {"candidate": value, "word": word.format(value), "before": before, "path": path, "y": 0}

    return [secret() if i % 2 else plain() for i in range(rows)]


class Tree:
    """A grown tree as arrays: feature (-1 in leaves), bound, left, right, value."""

    def __init__(self):
        self.feature, self.bound, self.left, self.right, self.value = [], [], [], [], []

    def add(self, value: float) -> int:
        for column, x in ((self.feature, -1), (self.bound, 0.0), (self.left, -1), (self.right, -1), (self.value, value)):
            column.append(x)
        return len(self.value) - 1


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> list[Tree]:
    """A random forest: bootstrap rows, random features at each node, Gini splits at quantiles."""
    rng = np.random.default_rng(seed)
    some = max(1, int(np.sqrt(x.shape[1])) + 1)

    def split(tree: Tree, rows: np.ndarray, left_depth: int) -> int:
        node = tree.add(float(y[rows].mean()))
        if not left_depth or len(rows) < 2 * LEAST_LEAF or y[rows].min() == y[rows].max():
            return node
        best = (1e-9, -1, 0.0)
        for f in rng.choice(x.shape[1], some, replace=False):
            values = x[rows, f]
            for bound in np.unique(np.quantile(values, np.linspace(0.05, 0.95, 13), method="lower")):
                low = values <= bound
                n = int(low.sum())
                if LEAST_LEAF <= n <= len(rows) - LEAST_LEAF:
                    p, q, r = y[rows[low]].mean(), y[rows[~low]].mean(), y[rows].mean()
                    gain = r * (1 - r) - (n * p * (1 - p) + (len(rows) - n) * q * (1 - q)) / len(rows)
                    if gain > best[0]:
                        best = (gain, int(f), float(bound))
        if best[1] >= 0:
            low = x[rows, best[1]] <= best[2]
            tree.feature[node], tree.bound[node] = best[1], best[2]
            tree.left[node], tree.right[node] = split(tree, rows[low], left_depth - 1), split(tree, rows[~low], left_depth - 1)
        return node

    forest = []
    for _ in range(trees):
        tree = Tree()
        split(tree, rng.integers(0, len(x), len(x)), depth)
        forest.append(tree)
    return forest


def vote(forest: list[Tree]) -> Column:
    """The forest's mean over the columns of FEATURES, as one expression."""

    def of(tree: Tree, node: int) -> Column:
        if tree.feature[node] < 0:
            return F.lit(round(tree.value[node], 6))
        return F.when(F.col(FEATURES[tree.feature[node]]) <= tree.bound[node], of(tree, tree.left[node])).otherwise(of(tree, tree.right[node]))

    return sum((of(t, 0) for t in forest[1:]), of(forest[0], 0)) / len(forest)


def fit(spark: SparkSession, findings: list[dict] | None = None) -> list[Tree]:
    """A forest from labelled findings (candidate, word, before, path, y), measured by the expressions that measure candidates."""
    rows = labelled_findings() if findings is None else findings
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<candidate:string,word:string,before:string,path:string,y:int>>")))
    known = measured(table).select(*FEATURES, "y").collect()
    data = np.array([list(r) for r in known], float)
    return grow(data[:, :-1], data[:, -1])


def scan(docs: DataFrame, forest: list[Tree], id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(id, word_no, candidate, score, secret): all candidates, with the forest's verdict."""
    scored = measured(candidates(docs, id_col, text_col, path_col)).withColumn("score", vote(forest))
    return scored.select(id_col, "word_no", "candidate", "score", (F.col("score") >= THRESHOLD).alias("secret"))

