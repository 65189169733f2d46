"""Detector queries: generated source files, and the given texts as they are."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.operators.consolidate import exact_dedup
from saltmarsh.operators.detect_calls import (
    call_sites, code_rows, detect_javascript, detect_python, unread_files,
)
from saltmarsh.operators.detect_config import cluster_secret_entries, detect_config, detect_infra
from saltmarsh.operators.detect_dependencies import detect_dependencies, extract_dependencies
from saltmarsh.operators.detect_secrets import (
    detect_entropy_secrets, detect_line_rules, secret_candidates,
)
from saltmarsh.plans.catalog import Tables, query
from saltmarsh.plans.scan import scan_files
from saltmarsh.plans.sources import expected_sql, source_files
from saltmarsh.sources.corpus import layers_of, prune_paths, reject_unsafe_paths, route_layers
from saltmarsh.sources.tables import explode_batches, parse_truth

COLS = ["scan_id", "path", "line", "rule_id", "algorithm", "severity", "confidence"]


def _of(t: Tables, layer: str):
    files = source_files(t)
    return files.filter(F.array_contains(layers_of(F.col("path")), layer))


@query("d01_d10_python_calls", expected_sql(["python"]))
def _(t: Tables):
    return detect_python(_of(t, "python")).select(*COLS)


@query("d11_d16_javascript_calls", expected_sql(["javascript"]))
def _(t: Tables):
    return detect_javascript(_of(t, "javascript")).select(*COLS)


@query("d17_d20_config", expected_sql(["config"]))
def _(t: Tables):
    return detect_config(_of(t, "config")).select(*COLS)


@query("d22_d24_infra", expected_sql(["infra"]))
def _(t: Tables):
    return detect_infra(_of(t, "infra")).select(*COLS)


@query("d25_dependencies", expected_sql(["manifest"]))
def _(t: Tables):
    return detect_dependencies(_of(t, "manifest")).select(*COLS)


@query("d21_entropy_in_sources", expected_sql(["entropy"]))
def _(t: Tables):
    return exact_dedup(detect_entropy_secrets(_of(t, "entropy"))).select(*COLS)


@query("scan_files_to_findings", expected_sql(merged=True))
def scan(t: Tables):
    """The whole scan: route, detect, fold, merge, correlate."""
    return scan_files(source_files(t), columns=COLS)


@query("x11_x14_j03_manifest_rows", """
SELECT CAST(o_orderkey AS VARCHAR) AS scan_id, ecosystem, library, replace(version, '{n}', CAST(o_orderkey AS VARCHAR)) AS version, line
FROM orders JOIN (VALUES (13, 'npm', 'md5', '^2.0.0', 2), (13, 'npm', 'jsonwebtoken', '^8.5.{n}', 2),
  (13, 'npm', 'node-rsa', '1.0', 3), (14, 'pip', 'rsa', '==4.{n}', 1), (14, 'pip', 'pycrypto', '>=2', 2),
  (14, 'pip', 'cryptography', '>=3', 4), (15, 'maven', 'bcprov-jdk15on', '1.{n}', 3))
  v(kind, ecosystem, library, version, line) ON o_orderkey % 24 = kind""")
def _(t: Tables):
    return extract_dependencies(_of(t, "manifest")).select(
        "scan_id", "ecosystem", "library", "version", "line")


# (kind, line, callee, function) of every kind of Python file; src/broken does not parse
_CALLS = [
    *[(0, 3, c, "login") for c in ("hashlib.md5", "password.encode")], (0, 5, "hashlib.sha1", "etag"),
    (0, 7, "hashlib.sha256", "safe"),
    (1, 5, "AES.new", None), *[(1, 6, c, None) for c in ("AES.new", "load")], *[(1, 7, c, None) for c in ("ARC4.new", "load")],
    *[(1, 8, c, None) for c in ("AES.new", "load")],
    (2, 3, "rsa.generate_private_key", None), *[(2, 4, c, None) for c in ("ec.generate_private_key", "ec.SECP256R1")],
    *[(2, 6, c, "make_token") for c in ("random.choice", "range")], (2, 10, "len", "check"),
    (3, 3, "load", None), (3, 4, "hmac.new", None), (3, 5, "Fernet", None), (3, 6, "Cipher", None),
    (3, 7, "algorithms.TripleDES", None), (3, 8, "modes.CBC", None), (3, 10, "dsa.generate_private_key", None),
    *[(16, 3, c, None) for c in ("DES.new", "load")], *[(16, 4, c, None) for c in ("DES3.new", "load")],
    *[(16, 5, c, None) for c in ("Blowfish.new", "f", "g", "h2", "i", "j")], *[(16, 6, c, None) for c in ("ARC4.new", "load")],
    (16, 7, "hashlib.new", None), *[(16, 9, c, None) for c in ("AES.new", "load")],
    *[(16, 10, c, None) for c in ("AES.new", "f", "g", "h2", "i", "j")],
    (17, 2, "RSA.generate", None), (17, 3, "rsa.newkeys", None), (17, 4, "DSA.generate", None),
    *[(17, 5, c, None) for c in ("Cipher", "algorithms.AES", "modes.ECB")],
    *[(17, 6, c, None) for c in ("Cipher", "algorithms.AES", "modes.CBC")],
    *[(17, 7, c, None) for c in ("Cipher", "algorithms.AES", "modes.GCM")],
    *[(17, line, c, None) for line in (8, 9) for c in ("hmac.new", "pick")], (17, 12, "random.choice", "inner"),
    (17, 13, "random.sample", "make_token"), (17, 15, "random.seed", None), (17, 17, "len", None),
]
# the same of every kind of JavaScript file
_JS_CALLS = [
    (4, 1, "require", None), *[(4, 3, c, None) for c in ("crypto.createCipheriv", "Buffer.from")],
    *[(4, 4, c, None) for c in ("crypto.createCipheriv", "load")], *[(4, 5, c, None) for c in ("crypto.createHash", "update", "digest")],
    (4, 6, "crypto.createSign", None), *[(4, 8, c, "generateResetToken") for c in ("Math.random", "toString")],
    (5, 1, "CryptoJS.TripleDES.encrypt", None), (5, 2, "CryptoJS.MD5", None), (5, 3, "KJUR.crypto.Signature", None),
    *[(5, line, "crypto.generateKeyPairSync", None) for line in (4, 7)], *[(5, 8, c, None) for c in ("crypto.createCipheriv", "load")],
    (18, 1, "crypto.createSign", None), (18, 2, "crypto.createVerify", None), (18, 3, "createVerify", None),
    (18, 4, "CryptoJS.RC4.encrypt", None), (18, 5, "CryptoJS.DES.encrypt", None),
    *[(18, 6, c, None) for c in ("CryptoJS.SHA1", "f", "g", "h", "i", "j")], (18, 7, "KJUR.crypto.Signature", None),
    *[(18, 11, c, None) for c in ("crypto.createHash", "update")], *[(18, 12, c, "makeToken") for c in ("Math.random", "toString")],
    (18, 14, "Math.random", None),
]


def _calls_sql(calls: list[tuple]) -> str:
    rows = ", ".join(f"({k}, {line}, '{callee}', " + (f"'{f}')" if f else "NULL)") for k, line, callee, f in calls)
    return f"""
SELECT CAST(o_orderkey AS VARCHAR) AS scan_id, line, callee, function FROM orders JOIN (VALUES {rows})
  v(kind, line, callee, function) ON o_orderkey % 24 = kind"""


@query("x15_x18_call_sites_of_every_kind", _calls_sql(_CALLS))
def _(t: Tables):
    """The calls of all Python files."""
    return call_sites(_of(t, "python"), "python").select("scan_id", "line", "callee", "function")


@query("x15_x18_call_sites", _calls_sql(_JS_CALLS))
def _(t: Tables):
    """The calls of all JavaScript files."""
    return call_sites(_of(t, "javascript"), "javascript").select("scan_id", "line", "callee", "function")


@query("x15_unread_files", """
SELECT CAST(o_orderkey AS VARCHAR) AS scan_id, 'src/broken' || o_orderkey || '.py' AS path, 'SyntaxError' AS reason, 2 AS line
FROM orders WHERE o_orderkey % 24 = 22""")
def _(t: Tables):
    """Python files that do not parse, with the reason."""
    return unread_files(code_rows(_of(t, "python"), "python")).select("scan_id", "path", "reason", "line")


@query("j01_j02_digests_through_imports_and_names", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'hashlib.sha1' WHEN 1 THEN 'hashlib.md5' WHEN 2 THEN '"md5"' ELSE 'other.sha1' END AS digest,
  CASE p_partkey % 4 WHEN 3 THEN 'other.new' ELSE 'hmac.new' END AS callee, 'sign' || p_partkey AS function FROM part""")
def _(t: Tables):
    """A call under an import's other name, its digest through names and imports, the last of them; a JavaScript constant by assignment."""
    n = F.col("p_partkey").cast("string")
    digest = F.element_at(F.array(*[F.lit(x) for x in ("D", "h.md5", "'md5'", "D")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    last = F.when(F.col("p_partkey") % 4 == 3, "import other as m, other as h\n").otherwise("")
    python = F.concat(F.lit("import hashlib as h, hmac as m\nD = E\nE = F = h.sha1\n"), last, F.lit("def sign"), n,
                      F.lit("(k):\n\tdef inner():\n\t\tpass\n\treturn m.new(k, b'', "), F.replace(digest, F.lit("'"), F.lit('"')), F.lit(")\n"))
    script = F.concat(F.lit("let d; d = \"md5\";\nfunction sign"), n, F.lit("(k) { (() => 1)(); return hmac.new(k, b, d); }\n"))
    text = F.when(F.col("p_partkey") % 4 == 2, script).otherwise(python)
    files = t.wide("part").select(n.alias("scan_id"), F.lit("r").alias("repo_id"), F.lit("a").alias("path"), text.alias("text"), "p_partkey")
    wanted = r"\.new$"
    both = call_sites(files.where("p_partkey % 4 <> 2"), "python", wanted).unionByName(
        call_sites(files.where("p_partkey % 4 = 2"), "javascript", wanted))
    return both.select(F.col("scan_id").cast("long").alias("p_partkey"), "digest", "callee", "function")


@query("x19_cluster_secret_entries", """
SELECT CAST(o_orderkey AS VARCHAR) AS scan_id, line, section, key, value FROM orders JOIN (VALUES
  (12, 4, 'data', 'pw', 'c2VjcmV0cHc='), (12, 6, 'stringData', 'tok', 'abcdefg')) v(kind, line, section, key, value)
  ON o_orderkey % 24 = kind""")
def _(t: Tables):
    return cluster_secret_entries(source_files(t)).select("scan_id", "line", "section", "key", "value")


@query("d26_line_rules", """
SELECT CAST(o_orderkey AS VARCHAR) AS scan_id, line, rule_id, severity FROM orders JOIN (VALUES
  (2, 3, 'CRYPTO-RULE-RSA-SHORT', 'critical'), (2, 4, 'CRYPTO-RULE-ECDSA-CLASSIC', 'high'),
  (3, 7, 'CRYPTO-RULE-DES-WEAK', 'high'), (3, 8, 'CRYPTO-RULE-AES-CBC-PADDING', 'medium'),
  (3, 4, 'CRYPTO-RULE-SHA1-DEP', 'high'),
  (3, 10, 'CRYPTO-RULE-RSA-SHORT', 'critical'), (4, 4, 'CRYPTO-ASSET-AES-GCM', 'info'),
  (4, 5, 'CRYPTO-RULE-MD5-BROKEN', 'critical'), (5, 1, 'CRYPTO-RULE-DES-WEAK', 'high'),
  (16, 14, 'CRYPTO-RULE-MD5-BROKEN', 'critical'), (17, 2, 'CRYPTO-RULE-RSA-SHORT', 'critical'),
  (17, 6, 'CRYPTO-RULE-AES-CBC-PADDING', 'medium'), (17, 7, 'CRYPTO-ASSET-AES-GCM', 'info'),
  (18, 5, 'CRYPTO-RULE-DES-WEAK', 'high'), (18, 9, 'CRYPTO-RULE-MD5-BROKEN', 'critical'),
  (18, 11, 'CRYPTO-RULE-SHA1-DEP', 'high'), (22, 3, 'CRYPTO-RULE-MD5-BROKEN', 'critical'))
  v(kind, line, rule_id, severity) ON o_orderkey % 24 = kind
WHERE rule_id <> 'CRYPTO-RULE-RSA-SHORT' OR o_custkey % 4 < 2""")
def _(t: Tables):
    return detect_line_rules(source_files(t)).select("scan_id", "line", "rule_id", "severity")


_text_hits = " UNION ALL ".join(
    f"SELECT '{name}' AS origin, CAST(item AS VARCHAR) AS item, rule_id, count(*) AS hits FROM (SELECT {key} AS item, "
    f"unnest(regexp_split_to_array({text}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')) AS line FROM {name}) l "
    "JOIN rules ON regexp_matches(line, pattern) GROUP BY ALL"
    for name, key, text in (
        ("documents", "doc_id", "text"), ("pages", "page_id", "html"),
        ("benchmark", "item_id", "text"),
        ("conversations", "conv_id || '/' || turn", "text")))


def _rules_sql() -> str:
    from saltmarsh.fixed_values import LINE_RULES
    values = ", ".join("('" + r[0] + "', '" + r[5].replace("'", "''") + "')" for r in LINE_RULES)
    return f"WITH rules AS (SELECT * FROM (VALUES {values}) v(rule_id, pattern)) " + _text_hits


@query("d26_line_rules_in_texts", _rules_sql())
def _(t: Tables):
    """The generic rules over every given text, whole."""
    parts = [("documents", F.col("doc_id"), "text"), ("pages", F.col("page_id"), "html"), ("benchmark", F.col("item_id"), "text"),
             ("conversations", F.concat_ws("/", "conv_id", "turn"), "text")]
    texts = None
    for name, key, text in parts:
        rows = t.wide(name).select(
            F.lit(name).alias("origin"), key.cast("string").alias("item"), F.col(text).alias("text"))
        texts = rows if texts is None else texts.unionByName(rows)
    return detect_line_rules(texts).groupBy("origin", "item", "rule_id").agg(
        F.count(F.lit(1)).alias("hits"))


# --- entropy over the given texts ---------------------------------------------
def _sql_secrets(table: str, key: str, text: str, pattern: str, groups: int, name_group: int = 1) -> str:
    """Assignments line by line, then the same signals, in SQL."""
    from saltmarsh import fixed_values as fv
    quoted = pattern.replace("'", "''")
    value = " || ".join(
        f"regexp_extract(hit, '{quoted}', {name_group + 1 + g})" for g in range(groups))
    single = "|".join(fv.SINGLE_SECRET_HINTS)
    compound = "|".join(fv.COMPOUND_SECRET_HINTS)
    holders = ", ".join(f"'{w}'" for w in fv.PLACEHOLDERS)
    return f"""
WITH lines AS (SELECT {key}, unnest(list_zip(l, range(1, len(l) + 1))) AS z
  FROM (SELECT {key}, string_split({text}, chr(10)) AS l FROM {table})),
hits AS MATERIALIZED (SELECT {key}, CAST(z[2] AS INTEGER) AS line,
  unnest(regexp_extract_all(z[1], '{quoted}', 0)) AS hit FROM lines),
vals AS MATERIALIZED (SELECT {key}, line, regexp_extract(hit, '{quoted}', {name_group}) AS name, {value} AS value FROM hits),
named AS MATERIALIZED (SELECT *, regexp_matches(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')),
    '(?:^|[^a-z0-9])(?:{single})(?:[^a-z0-9]|$)') OR regexp_matches(lower(name), '{compound}') AS name_hit
  FROM vals WHERE length(value) > 0),
clean AS MATERIALIZED (SELECT * FROM named WHERE NOT (lower(trim(value)) IN ({holders})
    OR regexp_matches(value, '^\\$\\{{[^}}]*\\}}$|^%[^%]+%$|^\\{{\\{{[^}}]+\\}}\\}}$|^\\$\\([^)]+\\)$')
    OR regexp_matches(value, '(?i)^\\d+\\.\\d+(\\.\\d+)?([.-][a-z0-9]+)*$')
    OR (regexp_matches(value, '(?i)^https?://[^\\s]+$') AND NOT regexp_matches(value, '(?i)^https?://[^@/]*:[^@/]*@'))
    OR regexp_matches(value, '^(?:/[^/\\s]+)+/?$')
    OR (contains(value, ' ') AND len(list_filter(regexp_split_to_array(value, '[^A-Za-z0-9]+'), lambda w: w <> '')) >= 3))),
measured AS (SELECT *, (SELECT -sum(n / CAST(length(value) AS DOUBLE) * log2(n / CAST(length(value) AS DOUBLE)))
    FROM (SELECT count(*) AS n FROM (SELECT unnest(string_split(value, '')) AS ch) GROUP BY ch)) AS entropy FROM clean)
SELECT {key}, line, name, CAST(length(value) AS INTEGER) AS len, round(entropy, 6) AS entropy,
  CASE WHEN length(value) >= 16 AND entropy >= 4 AND name_hit THEN 'entropy-secret-high-confidence'
    WHEN length(value) >= 16 AND entropy >= 4 THEN 'entropy-secret-high-entropy-only'
    ELSE 'entropy-secret-name-hint-only' END AS rule_id
FROM measured WHERE (length(value) >= 16 AND entropy >= 4) OR (name_hit AND length(value) >= 8)"""


_D, _S, _B = (f"{c}([^{c}\\\\]*(?:\\\\.[^{c}\\\\]*)*){c}" for c in "\"'`")
PY_SQL = f"(?:^|[^\\p{{L}}\\p{{N}}_])([A-Za-z_][A-Za-z0-9_]*)[ \\t]*=[ \\t]*(?:[brufBRUF]{{1,2}})?(?:{_D}|{_S})"
JS_SQL = ("(?:^[ \\t]*|[^\\p{L}\\p{N}_])(?:(?i:const|let|var))?[ \\t]*([A-Za-z_$][A-Za-z0-9_$]*)[ \\t]*[:=][ \\t]*"
          f"(?:{_D}|{_S}|{_B})")


def _secrets(rows, suffix: str, key: str):
    files = rows.select(
        F.col(key), F.lit("s").alias("scan_id"), F.lit("r").alias("repo_id"),
        F.concat(F.col(key).cast("string"), F.lit(suffix)).alias("path"), "text")
    found = secret_candidates(files)
    rule = (
        F.when(F.col("entropy_hit") & F.col("name_hit"), "entropy-secret-high-confidence")
        .when(F.col("entropy_hit"), "entropy-secret-high-entropy-only")
        .otherwise("entropy-secret-name-hint-only"))
    return found.select(
        key, "line", "name", F.length("value").alias("len"), F.round("entropy", 6).alias("entropy"),
        rule.alias("rule_id"))


@query("d21_entropy_in_documents", _sql_secrets("documents", "doc_id", "text", PY_SQL, 2))
def _(t: Tables):
    return _secrets(t.wide("documents").select("doc_id", "text"), ".py", "doc_id")


@query("d21_entropy_in_pages", _sql_secrets("pages", "page_id", "html", JS_SQL, 3))
def _(t: Tables):
    return _secrets(t.wide("pages").select("page_id", F.col("html").alias("text")), ".js", "page_id")


# --- routing and path rules ---------------------------------------------------
@query("s03_route_layers", """
SELECT CAST(o_orderkey AS VARCHAR) AS scan_id, layer FROM orders JOIN (VALUES
  (0, 'python'), (0, 'entropy'), (1, 'python'), (1, 'entropy'), (2, 'python'), (2, 'entropy'), (3, 'python'),
  (3, 'entropy'), (4, 'javascript'), (4, 'entropy'), (5, 'javascript'), (5, 'entropy'), (6, 'config'), (6, 'entropy'),
  (7, 'config'), (7, 'entropy'), (8, 'infra'), (8, 'config'), (8, 'entropy'), (9, 'config'), (9, 'entropy'),
  (10, 'infra'), (10, 'config'), (10, 'entropy'), (11, 'infra'), (12, 'infra'), (12, 'config'), (12, 'entropy'),
  (13, 'manifest'), (13, 'config'), (13, 'entropy'), (14, 'manifest'), (15, 'manifest'), (16, 'python'), (16, 'entropy'),
  (17, 'python'), (17, 'entropy'), (18, 'javascript'), (18, 'entropy'), (19, 'infra'), (19, 'config'), (19, 'entropy'),
  (20, 'infra'), (20, 'config'), (20, 'entropy'), (21, 'manifest'), (22, 'python'), (22, 'entropy'), (23, 'manifest'))
  v(kind, layer)
  ON o_orderkey % 24 = kind""")
def _(t: Tables):
    return source_files(t).select("scan_id", F.explode(layers_of(F.col("path"))).alias("layer"))


@query("s02_s06_path_rules", """
SELECT o_orderkey FROM orders WHERE o_orderkey % 7 IN (0, 3, 5)""")
def _(t: Tables):
    """Pruned folders and paths that leave the root disappear."""
    shapes = ["a/{n}.py", "node_modules/{n}.js", "a/../../{n}.py", "a/../b/{n}.py", "/abs/{n}.py", "build.py",
              "x/vendor/{n}.py"]
    path = F.replace(
        F.element_at(F.array(*[F.lit(s) for s in shapes]), (F.col("o_orderkey") % 7 + 1).cast("int")),
        F.lit("{n}"), F.col("o_orderkey").cast("string"))
    return reject_unsafe_paths(prune_paths(t.orders.withColumn("path", path))).select("o_orderkey")


@query("s04_extension_filter", """
SELECT CAST(o_orderkey AS VARCHAR) AS scan_id, count(*) AS layers FROM orders JOIN (VALUES
  (0, 2), (1, 2), (2, 2), (3, 2), (6, 2), (7, 2), (8, 3), (9, 2), (10, 3), (11, 3), (12, 3), (13, 3), (14, 1), (15, 3),
  (16, 2), (17, 2), (19, 3), (20, 3), (21, 3), (22, 2), (23, 1)) v(kind, n) ON o_orderkey % 24 = kind, unnest(range(n)) GROUP BY o_orderkey""")
def _(t: Tables):
    """Only Python among the plain sources; configuration and manifests stay regardless."""
    routed = route_layers(source_files(t), "cli", [".py"])
    return routed.groupBy("scan_id").agg(F.count(F.lit(1)).alias("layers"))


@query("s07_explode_batches", """
SELECT CAST(o_orderkey AS VARCHAR) AS scan_id, 'r' || o_custkey AS "repoId", CAST(i AS INTEGER) AS seq,
  'f' || i AS id, CASE i WHEN 0 THEN 'RSA' ELSE 'MD5' END AS primitive FROM orders, (VALUES (0), (1)) v(i)
WHERE o_orderkey % 3 <> 0""")
def _(t: Tables):
    """One row per finding of every batch; a third of the batches are empty."""
    one = lambda i, name: F.struct(F.lit(f"f{i}").alias("id"), F.lit(name).alias("primitive"))
    pair = F.array(one(0, "RSA"), one(1, "MD5"))
    batches = t.orders.select(
        F.col("o_orderkey").cast("string").alias("scan_id"),
        F.concat(F.lit("r"), F.col("o_custkey").cast("string")).alias("repoId"),
        F.when(F.col("o_orderkey") % 3 != 0, pair).otherwise(F.slice(pair, 1, 0)).alias("findings"))
    return explode_batches(batches)


@query("s15_truth", """
SELECT 'doc' || doc_id AS path, rule_id, quality + toxic AS min_count FROM labels
JOIN (SELECT doc_id AS d, unnest(CASE WHEN quality = 0 AND toxic = 0 THEN [NULL] ELSE
  list_filter([CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) END)
  AS rule_id FROM labels) ON d = doc_id""")
def _(t: Tables):
    """Expected rules written as JSON from the labels; a document may expect nothing."""
    names = F.array_compact(F.array(
        F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic")))
    doc = F.to_json(F.create_map(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")),
        F.struct(names.alias("expected_rule_ids"),
                 (F.col("quality") + F.col("toxic")).alias("expected_min_count"))))
    return parse_truth(t.labels.select(doc.alias("text")))


@query("j02_constant_chains", """
SELECT p_partkey, CASE WHEN p_partkey % 8 <= 5 THEN '"v' || p_partkey || '"' WHEN p_partkey % 8 = 6 THEN 'K0' ELSE 'K1' END
  AS key_value FROM part""")
def _(t: Tables):
    """A name six steps from its literal is followed, a longer chain is not."""
    n = F.col("p_partkey").cast("string")
    chain = "".join(f"K{i} = K{i - 1}\n" for i in range(1, 8))
    text = F.concat(
        F.lit('K0 = "v'), n, F.lit('"\n' + chain + "c = AES.new(K"),
        (F.col("p_partkey") % 8).cast("string"), F.lit(", AES.MODE_ECB)\n"))
    files = t.wide("part").select(
        n.alias("scan_id"), F.lit("r").alias("repo_id"), F.lit("a.py").alias("path"), text.alias("text"))
    calls = call_sites(files, "python", r"^AES\.new$")
    return calls.select(
        F.col("scan_id").cast("long").alias("p_partkey"), F.col("arg0_value").alias("key_value"))
