"""Text, value and version queries: whole given texts, and shapes filled from the parts table."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh import fixed_values as fv
from saltmarsh.functions import predicates as p
from saltmarsh.functions import severity as sv
from saltmarsh.functions import text as tx
from saltmarsh.functions.canonical import decrypt_col, encrypt_columns
from saltmarsh.operators.detect_calls import (
    call_sites, code_rows, constants, dsa_profile, ecc_profile, imports, rsa_profile, symmetric_profile,
)
from saltmarsh.plans.catalog import Tables, query
from saltmarsh.plans.q_detect import JS_SQL, PY_SQL
from saltmarsh.plans.sources import BITS, source_files


def filled(t: Tables, **shapes: list):
    """The parts table with one shape per row and column; {n} becomes the part number."""
    n = F.col("p_partkey")
    cols = {}
    for name, values in shapes.items():
        size = len(values)
        kind = "int" if any(isinstance(v, int) for v in values) else "string"
        picked = F.element_at(
            F.array(*[F.lit(v).cast(kind) for v in values]), (n % size + 1).cast("int"))
        cols[name] = picked if kind == "int" else F.replace(
            picked, F.lit("{n}"), n.cast("string"))
    return t.part.select("p_partkey").withColumns(cols)


def expected(rows: list[tuple], names: str) -> str:
    """SQL with the expected outcome of every shape, by part number."""
    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, int):
            return str(v)
        return "replace('" + v.replace("'", "''") + "', '{n}', n)"

    branches = " UNION ALL ".join(
        "SELECT p_partkey, " + ", ".join(f"{lit(v)} AS {c}" for v, c in zip(row, names.split()))
        + f" FROM numbered WHERE p_partkey % {len(rows)} = {i}" for i, row in enumerate(rows))
    return f"WITH numbered AS (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS n FROM part) {branches}"


# --- lines and assignments over whole texts -----------------------------------
BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
LINES = (f"SELECT doc_id, unnest(list_zip(range(1, len(l) + 1), l)) AS z FROM "
         f"(SELECT doc_id, regexp_split_to_array(text, '{BREAK}') AS l FROM documents)")


@query("x01_lines", f"SELECT doc_id, CAST(z[1] AS INTEGER) AS line, z[2] AS raw FROM ({LINES})")
def _(t: Tables):
    return tx.to_lines(t.wide("documents").select("doc_id", "text"))


@query("x02_drop_comments", f"""
SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, z[2] AS raw FROM ({LINES}))
WHERE regexp_matches(raw, '\\S') AND NOT regexp_matches(raw, '^\\s*(?://|/\\*|\\*)') GROUP BY doc_id""")
def _(t: Tables):
    lines = tx.drop_comments(tx.to_lines(t.wide("documents").select("doc_id", "text")), "javascript")
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"))


def _assignment_sql(table: str, key: str, text: str, pattern: str, groups: int) -> str:
    quoted = pattern.replace("'", "''")
    value = " || ".join(f"regexp_extract(hit, '{quoted}', {2 + g})" for g in range(groups))
    return f"""
WITH lines AS (SELECT {key}, unnest(list_zip(range(1, len(l) + 1), l)) AS z
  FROM (SELECT {key}, string_split({text}, chr(10)) AS l FROM {table})),
hits AS MATERIALIZED (SELECT {key}, CAST(z[1] AS INTEGER) AS line,
  unnest(regexp_extract_all(z[2], '{quoted}', 0)) AS hit FROM lines)
SELECT {key}, line, regexp_extract(hit, '{quoted}', 1) AS name, {value} AS value FROM hits"""


@query("x03_python_assignments", _assignment_sql("documents", "doc_id", "text", PY_SQL, 2))
def _(t: Tables):
    files = t.wide("documents").select("doc_id", F.lit("a.py").alias("path"), "text")
    return tx.assignments(files).select("doc_id", "line", "name", "value")


@query("x04_javascript_assignments", _assignment_sql("pages", "page_id", "html", JS_SQL, 3))
def _(t: Tables):
    files = t.wide("pages").select("page_id", F.lit("a.js").alias("path"), F.col("html").alias("text"))
    return tx.assignments(files).select("page_id", "line", "name", "value")


@query("p02_entropy", """
WITH chars AS (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents)
  GROUP BY doc_id, ch),
sums AS (SELECT doc_id, sum(n) AS total FROM chars GROUP BY doc_id)
SELECT doc_id, round(-sum(n / CAST(total AS DOUBLE) * log2(n / CAST(total AS DOUBLE))), 6) AS entropy
FROM chars JOIN sums USING (doc_id) GROUP BY doc_id""")
def _(t: Tables):
    return t.wide("documents").select("doc_id", F.round(p.shannon_entropy(F.col("text")), 6).alias("entropy"))


# --- configuration lines ------------------------------------------------------
@query("x05_env_assignments", expected([
    ("KEY_{n}", "v{n}"), ("Quoted", "in # side {n}"), ("S", "one"), (None, None), (None, None), ("A", "b=c{n}"),
    (None, None), ("EMPTY", "")], "name value"))
def _(t: Tables):
    rows = filled(t, raw=[
        "KEY_{n} = v{n} # note", 'Quoted="in # side {n}" tail', "S = 'one' # two", "# KEY=v{n}", "1BAD={n}",
        "A=b=c{n}", "plain {n}", "EMPTY="])
    pair = tx.env_assignment(F.col("raw"))
    return rows.select("p_partkey", pair["name"].alias("name"), pair["value"].alias("value"))


@query("x07_x10_key_values", expected([
    ("docker", "ENV", "A_{n}", "v{n}"), ("docker", "arg", "TOKEN", "x y"), ("docker", None, None, None),
    ("env", None, "K", "v{n}"), ("env", None, "Q", "a # b"), ("env", None, None, None),
    ("yaml", None, "key.{n}", "value"), ("yaml", None, "j", "v{n}"), ("yaml", None, "tpl", "${X{n}}"),
    ("ini", None, "host", "h{n}"), ("ini", None, "pw", "p"), ("ini", None, None, None)], "fmt word key value"))
def _(t: Tables):
    rows = filled(
        t, fmt=["docker"] * 3 + ["env"] * 3 + ["yaml"] * 3 + ["ini"] * 3,
        raw=['ENV A_{n}="v{n}"', "  arg TOKEN 'x y' # c", "RUN make {n}", "K = v{n} # c", 'Q="a # b"', "# K=1",
             "key.{n}: 'value', ", '{"j": "v{n}"}', "tpl: ${X{n}}", "host = h{n} ; c", "pw: 'p' # c", "; x={n}"])
    pair = None
    for fmt in ("docker", "env", "yaml", "ini"):
        value = tx.key_value(F.col("raw"), fmt)
        own = F.col("fmt") == fmt
        pair = F.when(own, value) if pair is None else pair.when(own, value)
    rows = rows.withColumn("kv", pair)
    return rows.select("p_partkey", "fmt", "kv.word", "kv.key", "kv.value")


@query("x06_s03_file_kinds", expected([
    ("python", None, ".py"), ("javascript", None, ".tsx"), ("config", "env", ""), ("config", "docker", ".dev"),
    ("config", "yaml", ".yml"), ("config", None, ".json"), ("config", "yaml", ".json"), ("config", "ini", ".toml"),
    ("config", None, "")], "language kind ext"))
def _(t: Tables):
    rows = filled(t, path=["a/{n}.py", "a/{n}.test.TSX", "x{n}/.env", "d{n}/Dockerfile.dev", "c{n}.yml",
                           "p{n}/package.json", "conf{n}.json", "a/{n}.toml", "bin/{n}"])
    path = F.col("path")
    return rows.select(
        "p_partkey", tx.language_of(path).alias("language"), tx.file_kind(path).alias("kind"),
        p.extension(path).alias("ext"))


# (kind, side, name, target) of every kind of Python file; breaks after brackets and commas count as one blank
_NAMES = [
    (0, "alias", "hl", "hashlib"), (1, "alias", "AES", "AES"), (1, "alias", "Old", "ARC4"),
    *[(2, "alias", x, x) for x in ("random", "rsa", "ec")], *[(3, "alias", x, x) for x in ("hmac", "hashlib", "Fernet")],
    *[(16, "alias", x, x) for x in ("DES", "DES3", "AES")], (16, "alias", "RC2", "ARC2"), (16, "alias", "RC4", "ARC4"),
    (16, "alias", "BF", "Blowfish"), (16, "alias", "h", "hashlib"),
    (17, "alias", "rnd", "random"), *[(17, "alias", x, x) for x in ("rsa", "hmac", "hashlib")], (22, "alias", "hashlib", "hashlib"),
    *[(1, "constant", *x) for x in (
        ("KEY", 'b"0123456789abcdef"'), ("ALIAS", "KEY"), ("iv_fixed", 'b"1234567890123456"'),
        ("a", "AES.new(ALIAS, AES.MODE_CBC, iv_fixed)"), ("b", "AES.new(load(), AES.MODE_ECB)"), ("c", "Old.new(load())"),
        ("d", "AES.new(load(), AES.MODE_GCM)"))],
    (2, "constant", "k", "rsa.generate_private_key(public_exponent=65537, key_size={b})"),
    (2, "constant", "e", "ec.generate_private_key(ec.SECP256R1())"),
    *[(3, "constant", *x) for x in (
        ("SECRETS", "load()"), ("m", "hmac.new(SECRETS, body, hashlib.sha1)"), ("f", "Fernet(SECRETS)"),
        ("c", "Cipher( algorithms.TripleDES(SECRETS), modes.CBC(iv))"), ("d", "dsa.generate_private_key(key_size={b})"))],
    *[(16, "constant", *x) for x in (
        ("a", "DES.new(load(), DES.MODE_ECB)"), ("b", "DES3.new(load(), mode=DES3.MODE_CBC)"),
        ("c", "BF.new(f(g(h2(i(j({n}))))), BF.MODE_CTR)"), ("d", "RC4.new(load())"), ("e", "h.new( 'MD5', body)"),
        ("g", "AES.new(load(), AES.MODE_SIV)"), ("k", "AES.new(f(g(h2(i(j({n}))))), AES.MODE_ECB)"),
        ("x", "'''\nDES.new(load(), DES.MODE_ECB)\n'''"), ("y", '"hashlib.md5(x)"'))],
    *[(17, "constant", *x) for x in (
        ("k", "RSA.generate({b})"), ("d", "DSA.generate({b})"), ("c", "Cipher(algorithms.AES(key), modes.ECB())"),
        ("e", "Cipher(algorithms.AES(b'0123456789abcdef'), modes.CBC(iv))"),
        ("f", "Cipher(algorithms.AES(key), mode=modes.GCM(nonce))"), ("w", "hmac.new(pick(), body, digestmod='md5')"),
        ("v", "hmac.new(pick(), body, hashlib.sha256)"), ("ok", "token == a == b"),
        ("fine", "len(token) == {n} and token is None"), ("bad", "token != other"))],
]
# the same of every kind of JavaScript file; white space counts as one blank
_JS_NAMES = [
    *[(4, "constant", *x) for x in (
        ("crypto", "require('crypto')"), ("key", "'abcdefghabcdefgh'"), ("c", "crypto.createCipheriv('aes-256-cbc', key, Buffer.from('0000'))"),
        ("g", "crypto.createCipheriv('aes-256-gcm', load(), iv)"), ("h", "crypto.createHash('md5').update(password).digest('hex')"),
        ("s", "crypto.createSign('SHA256')"))],
    *[(5, "constant", *x) for x in (
        ("a", "CryptoJS.TripleDES.encrypt(x, y)"), ("b", "CryptoJS.MD5(x)"), ("s", 'new KJUR.crypto.Signature({"alg": "SHA1withRSA"})'),
        ("p", "crypto.generateKeyPairSync('rsa', { modulusLength: {b} })"), ("q", "crypto.generateKeyPairSync('ec', { namedCurve: 'P-256' })"),
        ("d", "crypto.createCipheriv('des-ede3-cbc', load(), iv)"))],
    *[(18, "constant", *x) for x in (
        ("s", "crypto.createSign('ecdsa-with-SHA256')"), ("v", "crypto.createVerify('RSA-SHA256')"), ("w", "createVerify('EC-SHA{n}')"),
        ("a", "CryptoJS.RC4.encrypt(x, y)"), ("b", "CryptoJS.DES.encrypt(x, y)"), ("c", "CryptoJS.SHA1(f(g(h(i(j(x))))))"),
        ("g", 'new KJUR.crypto.Signature({"alg": "MD5withRSA"})'), ("t", '"CryptoJS.MD5(x)"'), ("r", "/CryptoJS.MD5(x)/"), ("ALGO", "'sha1'"),
        ("h", "crypto.createHash('sha1').update(`${CryptoJS}`)"), ("makeToken", "async (n) => { return Math.random().toString(n); }"),
        ("plain", "Math.random()"))],
]


def _names_sql(names: list[tuple]) -> str:
    rows = ", ".join(f"({k}, '{side}', '{name}', '" + target.replace("'", "''") + "')" for k, side, name, target in names)
    return f"""
SELECT CAST(o_orderkey AS VARCHAR) AS scan_id, side, name,
  replace(replace(target, '{{n}}', CAST(o_orderkey AS VARCHAR)), '{{b}}', CAST(([{", ".join(map(str, BITS))}])[o_custkey % 4 + 1] AS VARCHAR)) AS target
FROM orders JOIN (VALUES {rows}) v(kind, side, name, target) ON o_orderkey % 24 = kind"""


@query("x16_x17_j01_aliases_and_constants", _names_sql(_JS_NAMES))
def _(t: Tables):
    """All constants of all JavaScript files."""
    return _names(t, "javascript")


@query("x16_x17_j01_names_of_every_kind", _names_sql(_NAMES))
def _(t: Tables):
    """All aliases and constants of all Python files."""
    return _names(t, "python")


def _names(t: Tables, language: str):
    rows = code_rows(source_files(t).filter(tx.language_of(F.col("path")) == language), language)
    of = ["file", "scan_id"]  # a file has one scan
    aliases = imports(rows, of).select("scan_id", F.lit("alias").alias("side"), F.col("local").alias("name"), "target")
    values = constants(rows, of).select("scan_id", F.lit("constant").alias("side"), "name", F.col("value.text").alias("target"))
    return aliases.unionByName(values)


@query("x20_comparisons", expected([
    ("token", "===", "given{n}"), ("a.length", "!==", "b.length"), ("'x'", "==", "y{n}"), ("req.sig", "!=", "0")],
    "left_side op right_side"))
def _(t: Tables):
    rows = filled(t, code=["if (token === given{n}) {", "if (a.length !== b.length) return", "ok = 'x' == y{n}",
                           "while (req.sig != 0) {}"])
    files = rows.select(
        F.col("p_partkey").cast("string").alias("scan_id"), F.lit("r").alias("repo_id"), F.lit("a.js").alias("path"), F.col("code").alias("text"))
    found = call_sites(files, "javascript", "^$", comparisons=True)
    return found.select(F.col("scan_id").cast("long").alias("p_partkey"), F.col("left").alias("left_side"), "op", F.col("right").alias("right_side"))


@query("x21_split_cipher", expected([
    ("AES", 256, "CBC"), ("AES", 128, "GCM"), ("DES", None, "CBC"), ("RC4", None, None), ("AES", None, "ECB"),
    ("AES", None, "256")], "algo bits mode"))
def _(t: Tables):
    rows = filled(t, name=["aes-256-cbc", "aes-128-gcm", "des-ede3-cbc", "rc4", "aes-x-ecb", "aes-256"])
    parts = tx.split_cipher(F.col("name"))
    return rows.select("p_partkey", parts["algo"].alias("algo"), parts["bits"].alias("bits"), parts["mode"].alias("mode"))


# --- value predicates ---------------------------------------------------------
@query("p01_secret_names", expected([
    (True,), (True,), (False,), (False,), (True,), (True,), (False,), (True,), (False,), (True,)], "secret"))
def _(t: Tables):
    rows = filled(t, name=["apiKey{n}_key", "authToken", "keyboard{n}", "monkey_{n}", "db_password_{n}", "XDES_KEYS{n}",
                           "passcode{n}", "user.signature", "tokenizer_{n}", "my_private_token{n}"])
    return rows.select("p_partkey", p.is_secret_name(F.col("name")).alias("secret"))


@query("p03_p05_secret_values", expected([
    (False, True, True), (False, True, True), (False, True, False), (True, True, True), (False, True, False),
    (False, True, False), (False, False, False), (False, False, True), (False, True, False), (False, False, False)],
    "placeholder fp secret"))
def _(t: Tables):
    rows = filled(
        t,
        name=["uuid_key", "release_key", "link_x", "password", "home_x", "note_x", "x_{n}", "token", "v_x", "id_x"],
        value=["/usr/{n}/lib/k9", "1.{n}.2-beta", "https://host/{n}", "changeme", "/usr/lib/{n}", "three little words {n}",
               "abc{n}", "k3y-{n}-Zq81", "10.{n}", "plain"])
    rows = rows.withColumn("h", p.shannon_entropy(F.col("value")))
    name, value = F.col("name"), F.col("value")
    return rows.select(
        "p_partkey", p.is_placeholder(value).alias("placeholder"), p.is_likely_fp(value, name).alias("fp"),
        (p.is_secret_name(name) & (F.length(value) >= 8)).alias("secret"))


@query("p06_p07_algorithm_classes", expected([
    ("MD5", "Critical", True), (None, None, True), (None, None, True), ("SHA-1", "High", True),
    ("3DES/DES", "Critical", True), ("RC4", "Critical", True), ("ECB Mode", "Critical", True), (None, None, False),
    ("RIPEMD-160", "Medium", False), ("Blowfish/Legacy", "High", True)], "algorithm severity known"))
def _(t: Tables):
    rows = filled(t, value=["md5", "gzip", "sha256-rsa", "'SHA1'", "des_{n}", "rc4 stream {n}", "aes-ecb", "fast{n}",
                            "ripemd160", "idea/{n}"])
    weak = p.classify_algorithm(F.col("value"))
    return rows.select(
        "p_partkey", weak["algorithm"].alias("algorithm"), weak["severity"].alias("severity"),
        p.is_known_algorithm(F.col("value")).alias("known"))


@query("p08_p10_profiles", expected([
    ("AES-128-CBC", "Medium", "Quantum-Weakened", "RSA-512", "Critical", "High"),
    ("AES-256-CBC", "Low", "Quantum-Weakened", "RSA-1024", "High", "High"),
    ("AES-256-GCM", "Informational", "Safe", "RSA-2048", "Medium", "Medium"),
    ("AES-128-GCM", "Medium", "Quantum-Weakened", "RSA", "Medium", "Medium"),
    ("AES-ECB", "Critical", "Classical Risk", "RSA-3072", "Medium", "Medium"),
    ("DES", "Critical", "Classical Risk", "RSA-768", "Critical", "High")],
    "label severity risk rsa_label rsa_severity dsa_severity"))
def _(t: Tables):
    rows = filled(
        t, algo=["aes", "aes", "aes", "aes", "aes", "des"], mode=["cbc", "cbc", "gcm", "gcm", "ecb", None],
        bits=[128, 256, 256, 128, None, None], rsa=[512, 1024, 2048, None, 3072, 768])
    sym = symmetric_profile(F.col("algo"), F.col("mode"), F.col("bits"))
    rsa, dsa = rsa_profile(F.col("rsa")), dsa_profile(F.col("rsa"))
    return rows.select(
        "p_partkey", sym["label"].alias("label"), sym["severity"].alias("severity"), sym["risk"].alias("risk"),
        rsa["label"].alias("rsa_label"), rsa["severity"].alias("rsa_severity"), dsa["severity"].alias("dsa_severity"))


@query("p10_curve_profiles", """
SELECT p_partkey, 'ECDSA (' || p_type || ')' AS sign_label, 'ECDH (' || p_type || ')' AS agree_label,
  'Medium' AS severity FROM part""")
def _(t: Tables):
    sign, agree = ecc_profile(F.col("p_type")), ecc_profile(F.col("p_type"), "exchange")
    return t.part.select(
        "p_partkey", sign["label"].alias("sign_label"), agree["label"].alias("agree_label"),
        sign["severity"].alias("severity"))


@query("p11_p13_directives", expected([
    ("TLSv1, TLSv1.1", None, ""), (None, "3DES, RC4", ""), ("SSLv3", None, ""), (None, "EXPORT, NULL", ""),
    (None, None, "curl --insecure"), (None, None, "TLS verify disabled"), (None, None, "")],
    "protocols ciphers disabled"))
def _(t: Tables):
    rows = filled(t, line=["ssl_protocols TLSv1 TLSv1.1 TLSv1.2;", "SSLCipherSuite RC4:HIGH:3DES", "SSLProtocol all SSLv3",
                           "  ciphers NULL:EXPORT # {n}", "RUN curl --insecure http://h/{n}", "ssl: false",
                           "ssl_protocols TLSv1.2 TLSv1.3;"])
    line = F.col("line")
    found = lambda patterns, weak: F.nullif(
        F.array_join(p.weak_tokens(p.directive(line, patterns), weak), ", "), F.lit(""))
    return rows.select(
        "p_partkey", found(fv.PROTOCOL_DIRECTIVES, fv.WEAK_PROTOCOL).alias("protocols"),
        found(fv.CIPHER_DIRECTIVES, fv.WEAK_CIPHER).alias("ciphers"),
        F.array_join(p.tls_disabled_labels(line), ",").alias("disabled"))


@query("p14_p15_versions", """
SELECT p_partkey, (p_size, p_partkey % 10) < (9, 3) AS below_min,
  CASE WHEN (p_size, p_partkey % 10) < (9, 3) THEN 'Medium' ELSE 'Low' END AS severity FROM part""")
def _(t: Tables):
    version = F.concat(
        F.element_at(F.array(F.lit("^"), F.lit(">= "), F.lit("v")), (F.col("p_partkey") % 3 + 1).cast("int")),
        F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string"), F.lit("-rc1"))
    below = p.version_below(version, F.lit("9.3.0"))
    return t.part.select(
        "p_partkey", below.alias("below_min"),
        F.when(below, sv.bump_severity(F.lit("Low"))).otherwise("Low").alias("severity"))


@query("p16_base64_values", """
SELECT p_partkey, p_partkey % 3 = 0 OR (p_partkey % 3 = 1 AND length(CAST(p_partkey AS VARCHAR)) >= 4) AS secret FROM part""")
def _(t: Tables):
    kind = F.col("p_partkey") % 3
    value = F.when(kind == 0, F.base64(F.encode("p_name", "UTF-8"))).when(
        kind == 1, F.base64(F.encode(F.col("p_partkey").cast("string"), "UTF-8"))).otherwise("not base64!")
    return t.part.select("p_partkey", p.is_base64_secret(value).alias("secret"))


@query("p17_terraform_literals", expected([(True,), (False,), (False,), (True,), (False,)], "literal"))
def _(t: Tables):
    rows = filled(t, value=["secret-{n}", "var.key{n}", "${var.key{n}}", "${upper(x{n})}", "tiny"])
    return rows.select("p_partkey", p.is_terraform_literal(F.col("value")).alias("literal"))


@query("p26_p27_paths_and_lines", expected([
    ("src/{n}.py", "{n}.py", 1), ("a/b{n}", "b{n}", 3), ("x{n}", "x{n}", 7)], "path base line"))
def _(t: Tables):
    rows = filled(t, raw=["./src/{n}.py", "/a\\b{n}", " .//x{n} "], at=[0, 3, 9])
    path = p.normalize_path(F.col("raw"))
    return rows.select(
        "p_partkey", path.alias("path"), p.basename(path).alias("base"),
        p.clamp_line(F.col("at"), F.lit(7)).alias("line"))


@query("p40_redaction", """
SELECT page_id, url || ' = <' || length(html) || '-char literal>' AS shown, '[encrypted]' AS stored FROM pages""")
def _(t: Tables):
    return t.pages.select(
        "page_id", sv.redact_literal(F.col("url"), F.col("html")).alias("shown"),
        sv.redact_stored(F.col("html")).alias("stored"))


@query("p41_encryption", """
SELECT c_custkey, c_name AS back, c_mktsegment AS plain, true AS sealed FROM customer""")
def _(t: Tables):
    """Encrypt and decrypt; values without the prefix pass through."""
    key = F.unhex(F.sha2(F.lit("not a real key"), 256))
    sealed = encrypt_columns(t.customer.select("c_custkey", "c_name", "c_mktsegment"), ["c_name"], key)
    shape = r"^enc:v1:[\w-]{16}:[\w-]{22}:[\w-]+$"
    return sealed.select(
        "c_custkey", decrypt_col(F.col("c_name"), key).alias("back"),
        decrypt_col(F.col("c_mktsegment"), key).alias("plain"), F.col("c_name").rlike(shape).alias("sealed"))
