"""Secrets in texts: candidates by form, false positives removed by a random forest.

A candidate is a value that is assigned to a name (``name = "value"``), a long run of key characters with a
digit or mixed case, or a private key from its BEGIN to its END line. Values that are URLs are cut at their delimiters, and runs
inside an assigned value that is judged harmless are judged by themselves. What it is cannot be told from its form alone, so a forest
judges it by its length, its changes between character classes, how much of it dictionary words cover, the
path of the document and the words around it. The forest is MLlib's, trained from a table of labelled findings;
its trees are read from the saved model once and applied to whole Arrow batches, so that texts stay where they are.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_right
from collections import Counter
from itertools import chain
from math import log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelake.session import work_dir

TREES, DEPTH, SEED = 40, 8, 7
#: rows of labelled findings that are made when the caller brings none, and the bound for those that are brought
FINDINGS = 3_000
MOST_FINDINGS = 100_000
THRESHOLD = 0.5

ASSIGNED = re.compile(r"[=:][ \t]{0,3}([\"']?)([^\s\"',;]{6,})")
NAME = re.compile(r"([A-Za-z][A-Za-z0-9_-]{1,40})[\"']?[ \t]{0,3}$")
RUN = re.compile(r"[A-Za-z0-9+/_.~-]{12,}={0,2}")
KEY_HEAD = re.compile(r"-----BEGIN [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----")
KEY_END = re.compile(r"-----END [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----")
#: header and base64 lines; line ends may be written as ``\n`` or as spaces
KEY_LINES = re.compile(r"(?:(?:\s|\\[nr])+(?:[A-Za-z][A-Za-z0-9-]{1,30}: [^\n]*(?=\n)|[A-Za-z0-9+/]{16,}={0,2}|[A-Za-z0-9+/]{2,15}={1,2}|(?:[A-Za-z0-9+/]{4}){1,3}(?=[ \t]*(?:\r?\n|\\n|\Z))))*")
SCHEME = re.compile(r"(?:[A-Za-z][A-Za-z0-9+.-]{0,20}:)?//")
PATH_PART, QUERY_PART = re.compile(r"[^?&=:@/#;]{6,}"), re.compile(r"[^?&=:@#;]{6,}")
MIXED = re.compile(r"[a-z][A-Z]|[A-Z]{2}[a-z]")
WORD = re.compile(r"[^\W\d_]+")
TRIM = ".,-~/_"
# fixed values: words about secrets, words about harmless strings, marks of known key formats, stand-ins
SECRET_WORDS = {"password", "passwd", "pwd", "secret", "token", "apikey", "api", "key", "auth", "credential", "credentials", "bearer", "access", "private"}
HARMLESS_WORDS = {"commit", "sha", "md5", "checksum", "digest", "hash", "uuid", "guid", "build", "version", "revision", "isbn", "order", "invoice", "phone", "card", "file", "image", "url", "http", "https", "href", "src", "id", "etag", "license", "mail"}
KNOWN = ("AKIA", "ASIA", "ghp_", "gho_", "xoxb-", "xoxp-", "sk_live_", "sk-", "AIza", "eyJ", "glpat-", "npm_")
STAND_INS = ("xxxx", "changeme", "example", "your", "placeholder", "dummy", "redacted", "${", "{{", "<", "****", "12345678")
TEST_PATHS = re.compile(r"(?:^|[/_.-])(?:test|tests|example|examples|docs?|sample|fixture|mock)s?(?:$|[/_.-])", re.I)
FEATURES = ["length", "digits", "upper", "lower", "transitions", "entropy", "distinct", "hex", "dictionary", "letter_run", "digit_run",
            "assigned", "secret_name", "secret_near", "harmless_near", "test_path", "quoted", "known", "stand_in", "separators"]
FINDING_SCHEMA = "path string, before string, value string, after string, label int"
NEAR = 60  # characters before and after a candidate in which neighbouring words count


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), in order; only the runs inside an assigned value overlap with another, which comes before them."""
    heads = list(KEY_HEAD.finditer(text))
    keys = []
    for m, limit in zip(heads, [*(n.start() for n in heads[1:]), len(text)]):
        end = KEY_END.search(text, m.end(), limit) or KEY_LINES.match(text, m.end(), limit)
        keys.append((m.start(), end.end(), "private_key"))
    starts = [a for a, _, _ in keys]

    def in_key(a: int) -> bool:
        k = bisect_right(starts, a) - 1
        return k >= 0 and a < keys[k][1]

    def has_form(v: str) -> bool:
        return any(c.isdigit() for c in v) or bool(MIXED.search(v))

    out, urls = [], []
    for m in ASSIGNED.finditer(text):
        name = NAME.search(text, max(0, m.start() - 45), m.start())
        a, b = m.span(2)
        if SCHEME.match(text, a, b):
            urls.append((a, b))
            continue
        if name and not in_key(a):
            while b > a and text[b - 1] in ".)]}":
                b -= 1
            out.append((a, b, "assigned"))
    taken = []
    for a, b in urls:
        at = text.index("//", a, b) + 2
        path = next((k for k in range(at, b) if text[k] in "/?#"), b)
        query = next((k for k in range(path, b) if text[k] in "?#"), b)
        login = text.rfind("@", at, path)
        for m in chain(PATH_PART.finditer(text, at, path), PATH_PART.finditer(text, path, query), QUERY_PART.finditer(text, query, b)):
            x, y = m.span()
            while y > x and text[y - 1] in ".)]}":
                y -= 1
            if y - x < 6 or in_key(x):
                continue
            if text[x - 1] == "=" or login >= y and text[x - 1] == ":":
                out.append((x, y, "assigned"))
            elif login >= y or y - x >= 12 and has_form(text[x:y]) and not at <= x < path:
                taken.append((x, y, "run"))
    values = sorted(out)
    value_starts = [a for a, _, _ in values]
    url_starts = [a for a, _ in urls]
    for m in RUN.finditer(text):
        if not has_form(m.group()):
            continue
        a, b = m.span()
        k = bisect_right(url_starts, a) - 1
        if in_key(a) or k >= 0 and a < urls[k][1]:
            continue
        while b > a and text[b - 1] in TRIM:
            b -= 1
        while a < b and text[a] in TRIM:
            a += 1
        k = bisect_right(value_starts, a) - 1
        inside = k >= 0 and a < values[k][1]
        if b - a >= 12 and not (inside and a == values[k][0] and b >= values[k][1]):
            taken.append((a, b, "run"))
    found = {(a, b): (a, b, k) for a, b, k in [*taken, *out, *keys] if b - a >= 6}
    return sorted(found.values(), key=lambda c: (c[0], -c[1]))


def _classes(value: str) -> str:
    return "".join("d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in value)


def _covered(value: str, dictionary: frozenset[str]) -> float:
    """Part of the characters that dictionary words of four letters or more cover, longest first from the left."""
    n, hit = len(value), 0
    for m in WORD.finditer(value.lower()):
        w, i = m.group(), 0
        while i + 4 <= len(w):
            size = next((s for s in range(min(16, len(w) - i), 3, -1) if w[i: i + s] in dictionary), 0)
            hit += size
            i += size or 1
    return hit / max(n, 1)


def features(path: str, before: str, value: str, after: str, dictionary: frozenset[str]) -> list[float]:
    n = max(len(value), 1)
    kinds = _classes(value)
    counts = Counter(value)
    name = NAME.search(before.rstrip("\"' ").rstrip("=:").rstrip())
    assigned = bool(re.search(r"[=:][ \t]{0,3}[\"']?$", before))
    near = {w.lower() for w in WORD.findall(before[-NEAR:] + " " + after[:NEAR])}
    named = {w.lower() for w in WORD.findall(name[1])} if assigned and name else set()
    low = value.lower()
    return [
        float(n), kinds.count("d") / n, kinds.count("u") / n, kinds.count("l") / n,
        sum(x != y for x, y in zip(kinds, kinds[1:])) / max(n - 1, 1),
        -sum(c / n * log2(c / n) for c in counts.values()), len(counts) / n,
        float(all(c in string.hexdigits for c in value)), _covered(value, dictionary),
        float(max(map(len, re.findall(r"[ul]+", kinds)), default=0)), float(max(map(len, re.findall(r"d+", kinds)), default=0)),
        float(assigned), float(bool(named & SECRET_WORDS)), float(len(near & SECRET_WORDS)), float(len(near & HARMLESS_WORDS)),
        float(bool(path and TEST_PATHS.search(path))), float(before[-1:] in ("'", '"')), float(value.startswith(KNOWN) or value.startswith("-----BEGIN")),
        float(any(s in low for s in STAND_INS)), kinds.count("s") / n,
    ]


def made_findings(rows: int = FINDINGS, seed: int = SEED) -> pd.DataFrame:
    """Labelled findings by rule: keys and passwords in the forms they take, and strings that only look like them."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    some = lambda alphabet, n: "".join(alphabet[i] for i in rng.integers(len(alphabet), size=n))
    hexa, base32, base64, alnum = "0123456789abcdef", string.ascii_uppercase + "234567", string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits
    syllables = "an re ti on er in the ed ing tion ha or es st ly to en ou ch ei un der la que os mi ar".split()
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 5))))
    prose = lambda: " ".join(word() for _ in range(int(rng.integers(3, 9))))
    quote = lambda v, q: (q, v, q)
    address = lambda: f"{pick(['https', 'http'])}://{word()}.{pick(['example.com', 'org', 'net'])}/{word()}"
    paths = ["src0", "src7", "app/settings.py", "config/prod.env", "notes.txt", "deploy/values.yaml", "tests/fixtures/a.json", "docs/example.md", ""]
    out = []
    for i in range(rows):
        q, glue, name = pick(["", '"', "'"]), pick(["=", " = ", ": "]), pick(["password", "passwd", "token", "secret", "api_key", "auth_token", "access_key", "client_secret", "DB_PASSWORD"])
        path = pick(paths)
        if i % 2:
            kind = int(rng.integers(9))
            if kind == 0:
                b, v, a = quote(some(hexa, int(rng.choice([16, 18, 20, 32, 40, 64]))), q)
                b = f"{name}{glue}{b}"
            elif kind == 1:
                b, v, a = "", pick(["AKIA", "ASIA"]) + some(base32, 16), ""
            elif kind == 2:
                b, v, a = quote(some(alnum, int(rng.integers(10, 44))), q)
                b = f"{name}{glue}{b}"
            elif kind == 3:
                b, v, a = quote(pick(["ghp_", "xoxb-", "sk_live_", "AIza", "glpat-", "npm_"]) + some(alnum, int(rng.integers(20, 40))), q)
            elif kind == 4:
                b, v, a = f"{name}{glue}", some(alnum + "!$%^*", int(rng.integers(8, 20))) + pick("0123456789"), ""
            elif kind == 5:
                b, v, a = f"{name}{glue}{q}", some(base64, int(rng.choice([40, 44, 64]))), q
            elif kind == 6:
                v = pick([pick(["ghp_", "sk_live_", "AIza", "npm_"]) + some(alnum, int(rng.integers(20, 40))), some(alnum, int(rng.integers(16, 44))), some(hexa, int(rng.choice([32, 40])))])
                b, a = f"{address()}{pick(['?', f'?{word()}={word()}&'])}{pick(['access_token', 'token', 'api_key', 'key', 'auth', 'secret'])}=", pick(["", f"&{word()}={word()}"])
            elif kind == 7:
                v = pick([pick(["ghp_", "glpat-"]) + some(alnum, int(rng.integers(20, 40))), some(alnum, int(rng.integers(10, 30)))])
                b, a = f"{pick(['https', 'http', 'postgres', 'redis', 'amqp'])}://{pick([word(), 'user', 'admin', ''])}:", f"@{word()}.example.com/{word()}"
                if rng.integers(4) == 0:
                    b, v = "https://", pick(["ghp_", "glpat-"]) + some(alnum, int(rng.integers(20, 40)))
            else:
                body = some(base64, int(rng.integers(60, 1700)))
                kind, line = pick(["", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED "]), pick(["\n", "\n", " ", "\\n"])
                v = line.join([f"-----BEGIN {kind}PRIVATE KEY-----", *(body[k: k + 64] for k in range(0, len(body), 64)), *pick([[f"-----END {kind}PRIVATE KEY-----"], []])])
                b, a = pick(["", f"{name}{glue}{q}"]), ""
            label = 1
        else:
            kind = int(rng.integers(12))
            if kind == 0:
                b, v, a = f"{pick(['commit', 'sha', 'checksum', 'digest', 'build', 'etag', 'revision'])}{pick([' ', ': ', '='])}", some(hexa, int(rng.choice([32, 40, 64]))), ""
            elif kind == 1:
                b, v, a = pick(["uuid ", "id=", "", "guid: "]), "-".join(some(hexa, n) for n in (8, 4, 4, 4, 12)), ""
            elif kind == 2:
                b, v, a = pick(["", "order ", "card ", "isbn ", "phone: "]), some(string.digits, int(rng.integers(12, 20))), ""
            elif kind == 3:
                b, v, a = f"{name}{glue}{q}", pick(["changeme123", "xxxxxxxxxxxx", "your_token_here", "example-password-1", "${DB_PASSWORD}", "<password>", "{{token}}", "placeholder0", "********", "None", "os.environ", "getpass()", "request.token"]), q
            elif kind == 4:
                b, v, a = pick(["", "http://", "file "]), f"{word()}.{word()}{pick(['.example.com', '.org', '.net'])}/{word()}/{some(string.digits, 4)}", ""
            elif kind == 5:
                b, v, a = "", word() + word().title() + word().title() + pick(["", "2", "Id"]), ""
            elif kind == 6:
                b, v, a = "", ".".join(some(string.digits, int(rng.integers(1, 4))) for _ in range(4)), ""
            elif kind == 7:
                b, v, a = f"{word()}{glue}", pick([prose().replace(" ", "_"), word() + word(), some(string.digits, 8)]), ""
            elif kind == 8:
                b, v, a = "", f"{word()}.{some(string.digits, 2)}", f"@{word()}.example.com"
            elif kind == 9:
                b, v, a = f"{address()}?{pick(['id', 'page', 'ref', 'q', 'utm_source', 'lang', 'v', word()])}=", pick([some(string.digits, int(rng.integers(6, 14))), word() + word(), f"{word()}-{word()}", f"{word()}{some(string.digits, 3)}"]), pick(["", f"&{word()}={word()}"])
            elif kind == 10:
                b, v, a = pick([(f"{address()}/", pick([f"{word()}-{word()}-{some(string.digits, 5)}", some(hexa, 40), f"{word()}{some(string.digits, 8)}.html"]), ""),
                                (f"https://{word()}:", pick(["password", "<password>", "xxxxxxxx", "changeme", "${TOKEN}", "your_token"]), f"@{word()}.example.com"),
                                (f"{address()}?token=", pick(["xxxxxxxxxxxx", "your_token_here", "<token>", "${TOKEN}", "{{token}}"]), "")])
            else:
                b, v, a = "", "-".join(word() for _ in range(4)) + pick(["", "-2024", "-v2.0.1"]), ""
            label = 0
        out.append((path, f"{prose()} {b}", v, f"{a} {prose()}", label))
    return pd.DataFrame(out, columns=["path", "before", "value", "after", "label"])


class Forest:
    """Trees of a fitted MLlib forest as arrays; a child index of -1 marks a leaf."""

    def __init__(self, feature, threshold, left, right, share, roots):
        self.feature, self.threshold, self.left, self.right, self.share, self.roots = feature, threshold, left, right, share, roots

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (inner := self.left[at] >= 0).any():
                go = x[rows, self.feature[at]] <= self.threshold[at]
                at = np.where(inner, np.where(go, self.left[at], self.right[at]), at)
            total += self.share[at]
        return total / max(len(self.roots), 1)


def dictionary_of(findings: pd.DataFrame) -> frozenset[str]:
    """Words of four letters or more around the labelled findings."""
    return frozenset(w for t in (findings["before"], findings["after"]) for x in t.fillna("") for w in WORD.findall(x.lower()) if 4 <= len(w) <= 16)


def fit(spark: SparkSession, findings: DataFrame | None = None, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> tuple[Forest, frozenset[str]]:
    """The forest and the dictionary learned from labelled findings (path, before, value, after, label 0/1).

    At most ``MOST_FINDINGS`` rows are used, the first by a hash of their content. Rows with a null value or label are
    left out; other nulls are empty. Both labels must occur.
    """
    if findings is None:
        rows = made_findings(seed=seed)
    else:
        columns = ["path", "before", "value", "after", "label"]
        rows = findings.where("value is not null and label is not null").select(*columns).orderBy(F.xxhash64(*columns), *columns).limit(MOST_FINDINGS).toPandas().fillna({"path": "", "before": "", "after": ""})
    if set(rows["label"]) != {0, 1}:
        raise ValueError("labelled findings must hold both labels")
    words = dictionary_of(rows)
    x = [features(p, b, v, a, words) for p, b, v, a in zip(rows["path"], rows["before"], rows["value"], rows["after"])]
    train = spark.createDataFrame(pd.DataFrame({"x": x, "label": rows["label"].astype(float)})).repartition(4).select(array_to_vector("x").alias("features"), "label")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(train)
    path = work_dir(spark, "secret-forest")
    model.save(path)
    # rows of nodes, bounded by trees * 2 ** (depth + 1)
    data = spark.read.parquet(f"{path}/data")
    nodes = sorted(data.select("treeID", "nodeData.*").collect(), key=lambda r: (r["treeID"], r["id"]))
    at = {(r["treeID"], r["id"]): i for i, r in enumerate(nodes)}
    child = lambda r, k: at[r["treeID"], r[k]] if r[k] >= 0 else -1
    return Forest(
        np.array([max(r["split"]["featureIndex"], 0) for r in nodes]),
        np.array([r["split"]["leftCategoriesOrThreshold"][0] if r["leftChild"] >= 0 else 0.0 for r in nodes]),
        np.array([child(r, "leftChild") for r in nodes]), np.array([child(r, "rightChild") for r in nodes]),
        np.array([r["impurityStats"][1] / max(sum(r["impurityStats"]), 1e-9) for r in nodes]),
        np.array([at[t, 0] for t in sorted({r["treeID"] for r in nodes})]),
    ), words


def _judged(forest: Forest, words: frozenset[str], threshold: float, texts: list, paths: list) -> list[tuple[int, list]]:
    """For each text the number of its candidates and (start, end, kind, probability) of its secrets."""
    found = [candidates(t) if t else [] for t in texts]
    x = [features(p or "", t[max(0, a - 2 * NEAR): a], t[a:b], t[b: b + NEAR], words) for t, p, spans in zip(texts, paths, found) for a, b, _ in spans]
    p = forest.probability(np.array(x)) if x else np.zeros(0)
    out, k = [], 0
    for spans in found:
        secrets, end = [], 0
        for (a, b, kind), q in zip(spans, p[k: k + len(spans)]):
            # runs inside a value count only where the value itself is none
            if q >= threshold and a >= end:
                secrets.append((a, b, kind, float(q)))
                end = b
        out.append((len(spans), secrets))
        k += len(spans)
    return out


def finding_columns(forest: Forest, words: frozenset[str], threshold: float = THRESHOLD):
    """A column function (text, path) -> struct(n_candidates, secrets: array of struct(start, end, kind, score))."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())])

    def scanned(text: pa.Array, path: pa.Array) -> pa.Array:
        found = _judged(forest, words, threshold, text.to_pylist(), path.to_pylist())
        spans = [[dict(zip(("start", "end", "kind", "score"), s)) for s in secrets] for _, secrets in found]
        return pa.StructArray.from_arrays([pa.array([n for n, _ in found], pa.int32()), pa.array(spans, pa.list_(span))], names=["n_candidates", "secrets"])

    return F.arrow_udf(scanned, "n_candidates int, secrets array<struct<start: int, end: int, kind: string, score: double>>")


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_candidates, n_secrets, secrets (code-point spans, end exclusive).

    Null and empty texts have none; a null path counts as empty. Repeated rows give repeated results.
    """
    forest, words = fit(docs.sparkSession, findings)
    column = finding_columns(forest, words, threshold)(F.col(text_col), F.col(path_col).cast("string"))
    return docs.select(F.col(id_col).alias("doc_id"), column.alias("f")).select("doc_id", "f.n_candidates", F.size("f.secrets").alias("n_secrets"), "f.secrets")


def redact(docs: DataFrame, findings: DataFrame | None = None, text_col: str = "text", path_col: str = "source", mark: str = "[secret]", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every secret in its texts replaced by ``mark``; all rows and columns stay."""
    forest, words = fit(docs.sparkSession, findings)

    def cleaned(text: pa.Array, path: pa.Array) -> pa.Array:
        texts = text.to_pylist()
        out = []
        for t, (_, secrets) in zip(texts, _judged(forest, words, threshold, texts, path.to_pylist())):
            for a, b, _, _ in reversed(secrets):
                t = t[:a] + mark + t[b:]
            out.append(t)
        return pa.array(out, pa.string())

    return docs.withColumn(text_col, F.arrow_udf(cleaned, "string")(F.col(text_col), F.col(path_col).cast("string")))
