"""Detectors on small files written for these tests; secrets here are made up."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from saltmarsh.functions import predicates as p
from saltmarsh.functions.text import assignments
from saltmarsh.operators import consolidate as c
from saltmarsh.operators.detect_calls import detect_javascript, detect_python
from saltmarsh.operators.detect_config import detect_config
from saltmarsh.operators.detect_dependencies import detect_dependencies
from saltmarsh.operators.detect_secrets import detect_entropy_secrets
from saltmarsh.plans.scan import scan_files
from saltmarsh.sources.corpus import (
    enforce_quota, prune_paths, quota_report, read_corpus, reject_unsafe_paths, route_layers, store_corpus,
)
from saltmarsh.sources.tables import parse_suppressions, parse_truth


def rules(df):
    return sorted((r.line, r.rule_id) for r in df.select("line", "rule_id").collect())


@pytest.mark.parametrize("name,secret", [
    ("monkey", False), ("keyboard", False), ("author", False), ("passage", False), ("tokenizer", False),
    ("api_key", True), ("authToken", True), ("userPassword", True), ("DB_PASS", True), ("privateKey", True)])
def test_secret_names(spark, name, secret):
    assert spark.range(1).select(p.is_secret_name(F.lit(name))).first()[0] is secret


def test_entropy_matches_the_formula(spark):
    values = ["", "aaaa", "abcd", "Zx81kQ9LmB4vT7cR", "été été", "0123456789abcdef"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for r in df.select("v", p.shannon_entropy(F.col("v")).alias("h")).collect():
        n = len(r.v)
        want = -sum(k / n * math.log2(k / n) for k in Counter(r.v).values()) if n else 0.0
        assert r.h == pytest.approx(want, abs=1e-12)


def test_entropy_sorts_numbers(spark):
    """Characters beyond 16 bits count as one, and no text is sorted through a comparison of strings."""
    values = ["\U0001f511\U0001f512\U0001f511a", "\x00\x00b", "ﬃé\n" * 3000 + "z", "".join(map(chr, range(0x4e00, 0x5600))) * 2]
    df = spark.createDataFrame([(v,) for v in [*values, "", None]], "v string").select("v", p.shannon_entropy(F.col("v")).alias("h"))
    got = {r.v: r.h for r in df.collect()}
    assert got[""] == 0.0 and got[None] == 0.0
    for v in values:
        assert got[v] == pytest.approx(-sum(k / len(v) * math.log2(k / len(v)) for k in Counter(v).values()), abs=1e-9)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "ascii" in plan and "array_sort" not in plan


PY_ASSIGNMENT = re.compile(
    r"(?:^[ \t]*|\b)([A-Za-z_][A-Za-z0-9_]*)[ \t]*=[ \t]*(?:[brufBRUF]{1,2})?"
    r"(?:\"([^\"\\]*(?:\\.[^\"\\]*)*)\"|'([^'\\]*(?:\\.[^'\\]*)*)')", re.MULTILINE)


def test_assignments_over_lines_match_a_whole_text_search(files_df):
    text = ('a = "one"\n  b=b\'two\' # c = "no"\nf(x="multi\nline", y = "k=\'v\'")\n# d = "skip"\n'
            'é_x = "u"\nlong = "' + "\\x41" * 5000 + '"\nz = ""\n')
    got = [(r.line, r.name, r.value) for r in assignments(files_df(("m.py", text))).orderBy("seq").collect()]
    want = []
    for m in PY_ASSIGNMENT.finditer(text):
        start = text.rfind("\n", 0, m.start()) + 1
        if not text[start:m.start()].lstrip().startswith("#"):
            value = m.group(2) if m.group(2) is not None else m.group(3)
            want.append((text[:m.start()].count("\n") + 1, m.group(1),
                         value.replace("\\n", "\n").replace("\\t", "\t")))
    assert got == want


def test_python_calls(files_df):
    found = detect_python(files_df(("a.py", """from hashlib import md5 as digest
key = load()
def reset_token():
    value = random.randint(0, 9)
    return digest(value)
aes = AES.new(key, AES.MODE_CBC, iv)
same = AES.new(b"0123456789abcdef", AES.MODE_GCM, nonce=b"123456789012")
if len(token) == 4:
    pass
if sig != other.sig: pass
if password == "": pass
# hashlib.md5(x)
""")))
    assert rules(found) == [
        (4, "insecure-rng"), (5, "md5-hashing"), (6, "aes-missing-aead"), (7, "aes-aead-mode"),
        (7, "aes-hardcoded-key"), (7, "aes-static-iv-reuse"), (10, "timing-unsafe-compare")]


def test_fixed_file_is_less_severe(files_df):
    bad = detect_javascript(files_df(("a.js", (
        "const k = 'abcdefghijklmnop';\n"
        "const c = crypto.createCipheriv('aes-128-cbc', k, Buffer.from('1'));\n"))))
    good = detect_javascript(files_df(("a.js", (
        "const iv = crypto.randomBytes(16);\n"
        "const c = crypto.createCipheriv('aes-256-cbc', loadKey(), iv);\n"))))
    assert {r.severity for r in bad.collect()} == {"Critical", "High"}
    assert {(r.rule_id, r.severity) for r in good.collect()} == {("aes-missing-aead", "Low")}


def test_benign_configuration_is_quiet(files_df):
    clean = files_df(
        ("c.yml", "compression: gzip\nbalance: round-robin\nhash: sha256\npassword: ${DB}\ntoken: changeme\n"),
        ("Dockerfile", "ENV ALGO=aes-256-gcm\nRUN curl https://x\n"), (".env", "SECRET=<secret>\n"))
    assert detect_config(clean).count() == 0


def test_entropy_rules(files_df):
    found = detect_entropy_secrets(files_df(("s.py", (
        'api_token = "Zx81kQ9LmB4vT7cRw2"\nblob = "Zx81kQ9LmB4vT7cRw2"\npassword = "hunter2x"\n'
        'note = "three plain english words"\nurl = "https://example.org/Zx81kQ9LmB4vT7cRw2"\nkey = "short"\n'))))
    assert rules(found) == [
        (1, "entropy-secret-high-confidence"), (2, "entropy-secret-high-entropy-only"),
        (3, "entropy-secret-name-hint-only")]


def test_layers_agreeing_on_a_secret_become_one(files_df):
    found = scan_files(files_df((".env", "API_KEY=abcd1234efgh\nALGO=md5\n")))
    got = {(r.line, r.rule_id): (r.severity, r.confidence) for r in found.collect()}
    assert got == {(1, "entropy-secret-name-hint-only"): ("High", "Confirmed"),
                   (2, "config-weak-algorithm"): ("Critical", "Possible")}


def test_manifest_and_source_confirm_each_other(files_df):
    found = scan_files(files_df(
        ("requirements.txt", "rsa==4.9\nparamiko==3\n"), ("a.py", "k = RSA.generate(2048)\nh = md5(x)\n")))
    got = {r.rule_id: r.confidence for r in found.collect()}
    assert got == {"sca-pip-rsa": "Confirmed", "sca-pip-paramiko": "Likely",
                   "rsa-key-generation": "Confirmed", "md5-hashing": "Likely"}


def test_allow_list_flags_but_keeps(spark, files_df):
    lines = spark.createDataFrame(
        [(0, "# note"), (1, "md5-hashing|src/legacy.py|2"), (2, "other|x.py")], "seq int, line string")
    found = scan_files(
        files_df(("src/legacy.py", "a = 1\nb = hashlib.md5(x)\nc = hashlib.sha1(x)\n")),
        parse_suppressions(lines))
    got = {r.rule_id: (r.suppressed, r.suppression_reason) for r in found.collect()}
    assert got["md5-hashing"] == (True, "Suppressed by rule 'md5-hashing' on src/legacy.py:2")
    assert got["sha1-hashing"] == (False, "")


def test_allow_list_paths_strict_or_by_base_name(spark, files_df):
    found = c.exact_dedup(detect_python(files_df(("deep/app.py", "h = md5(x)\n"))))
    rule = parse_suppressions(spark.createDataFrame([(0, "other/app.py")], "seq int, line string"))
    assert c.apply_suppressions(found, rule).first().suppressed is True
    assert c.apply_suppressions(found, rule, strict_paths=True).first().suppressed is False


def test_dedup_is_idempotent_and_keeps_the_first(files_df):
    raw = detect_python(files_df(("a.py", "x = md5(a); y = md5(password)\nz = md5(b); w = md5(c)\n")))
    once = c.exact_dedup(raw)
    assert rules(once) == [(1, "md5-weak-password-hash"), (2, "md5-hashing")]
    assert once.collect() == c.exact_dedup(once).collect()


def test_corpus_reading_routing_and_limits(spark, files_df, tmp_path):
    (tmp_path / "src dir").mkdir()
    (tmp_path / "src dir" / "a.py").write_bytes(b"x = 1\n\xff\xfe\n")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "b.js").write_text("y")
    for hidden in (".env", "__init__.py", "_lib/k.py", ".git/config", "a+b%20c/.env.local"):
        (tmp_path / hidden).parent.mkdir(exist_ok=True)
        (tmp_path / hidden).write_text(f"in {hidden}")
    kept = {"src dir/a.py", ".env", "__init__.py", "_lib/k.py", "a+b%20c/.env.local"}
    files = read_corpus(spark, str(tmp_path), "s", "r")
    assert {r.path for r in files.collect()} == kept
    assert {r.text for r in files.collect() if r.path != "src dir/a.py"} == {f"in {p}" for p in kept - {"src dir/a.py"}}
    every = read_corpus(spark, f"file://{tmp_path}", "s", "r", pruned=[])
    assert {r.path for r in every.collect()} == kept | {"node_modules/b.js", ".git/config"}
    assert {r.path for r in prune_paths(every).collect()} == kept
    assert {r.path for r in read_corpus(spark, str(tmp_path), "s", "r", [".js"]).collect()} == {".env", "a+b%20c/.env.local"}
    store_corpus(files, str(tmp_path / "stored"))
    assert spark.read.parquet(str(tmp_path / "stored")).select("kind").first().kind == "python"
    routed = route_layers(files_df(("pom.xml", ""), ("x.tf", ""), ("a.txt", "")), "cli")
    assert {(r.path, r.layer) for r in routed.collect()} == {
        ("pom.xml", "manifest"), ("pom.xml", "config"), ("pom.xml", "entropy"), ("x.tf", "infra"),
        ("x.tf", "config"), ("x.tf", "entropy")}
    assert reject_unsafe_paths(files_df(("../x", ""), ("a/../../x", ""), ("a/../x", ""))).count() == 1
    assert enforce_quota(files_df(("a", "x" * 10), ("b", "y")), max_files=2, max_bytes=10).count() == 0
    assert enforce_quota(files_df(("a", "x" * 10), ("b", "y"))).count() == 2
    report = quota_report(files_df(("a", "x" * 10), ("b", "y")), max_files=1, max_bytes=10).first()
    assert (report.files, report.bytes, report.accepted) == (2, 11, False) and report.reason == "2 files, at most 1, 11 bytes, at most 10"


def test_truth_keeps_paths_that_expect_nothing(spark):
    doc = spark.createDataFrame([(
        '{"a": {"expected_rule_ids": ["r1", "r2"], "expected_min_count": 2}, "b": {"expected_rule_ids": []}}',)],
        "text string")
    assert sorted((r.path, r.rule_id) for r in parse_truth(doc).collect() if r.rule_id) == [("a", "r1"), ("a", "r2")]
    assert [r.rule_id for r in parse_truth(doc).collect() if r.path == "b"] == [None]


PYTHON_CASES = {
    "import rsa\nAES.new(f(g(h(i(1)))), AES.MODE_ECB)\n": ["aes-ecb-mode"],
    "import random as rnd\ndef make_token():\n    return rnd.choice(x)\n": ["insecure-rng"],
    "import random\ndef make_token():\n    pass\nif True:\n    random.seed(1)\n": [],
    'x = """\nhashlib.md5(x)\n"""\n': [],
    "# hashlib.md5(x)\ny = 'hashlib.md5(x)'\n": [],
    "ok = token == a == b\n": [],
    "ok = token == other\n": ["timing-unsafe-compare"],
    "if token == (a\n    or b): pass\n": ["timing-unsafe-compare"],
    "digest = hashlib.new(\n    'MD5',\n    data)\n": ["md5-hashing"],
    "def broken(:\n  hashlib.md5(x)\n": [],
    "DES.new(k, DES.MODE_CBC)\nDES3.new(k, DES3.MODE_CBC)\nARC4.new(k)\nBlowfish.new(k)\n": [
        "arc4-deprecated-cipher", "blowfish-deprecated-cipher", "des-deprecated-cipher", "des3-deprecated-cipher"],
    "RSA.generate(1024)\nrsa.newkeys(512)\nDSA.generate(1024)\n": ["dsa-key-generation", "rsa-key-generation", "rsa-key-generation"],
    "c = Cipher(algorithms.AES(key), modes.ECB())\nd = Cipher(algorithms.TripleDES(key), modes.CBC(iv))\n": [
        "aes-ecb-mode", "tripledes-deprecated-cipher"],
    "hmac.new(k, m, hashlib.md5)\nhmac.new(k, m, digestmod='sha1')\n": ["md5-hmac-weak-digest", "sha1-hmac-weak-digest"],
}
JAVASCRIPT_CASES = {
    "// crypto.createHash('md5')\n/* crypto.createHash('md5') */ const s = \"crypto.createHash('md5')\";\n": [],
    "crypto.createHash(\n  'md5'\n).update(f(g(h(i(j(1))))))\n": ["md5-hashing"],
    "function makeToken() { return 1; }\nconst x = Math.random();\n": [],
    "const makeToken = async (n) => { return Math.random().toString(n); };\n": ["insecure-rng"],
    "const re = /crypto.createHash('md5')/;\n": [],
    "if (user?.password === given) {}\n": ["timing-unsafe-compare"],
    "crypto.generateKeyPairSync('ec', { namedCurve: 'P-256',\n  nested: { deep: [1, (2)] } });\n": ["ecdsa-key-generation"],
    "crypto.createCipheriv('des-cbc', k, iv)\n": ["des-deprecated-cipher"],
}


def test_calls_as_a_parser_sees_them(files_df):
    for cases, detect, ext in ((PYTHON_CASES, detect_python, "py"), (JAVASCRIPT_CASES, detect_javascript, "js")):
        texts = list(cases)
        found = {}
        for r in detect(files_df(*[(f"f{i}.{ext}", t) for i, t in enumerate(texts)])).collect():
            found.setdefault(int(r.path[1:].split(".")[0]), []).append(r.rule_id)
        assert {t: sorted(found.get(i, [])) for i, t in enumerate(texts)} == {t: sorted(v) for t, v in cases.items()}


def test_manifest_xml_is_read_as_xml(files_df):
    dep = "<dependency><groupId>org.bouncycastle</groupId><artifactId>bcprov-jdk15on</artifactId><version>1.60</version></dependency>"
    head = '<?xml version="1.0"?>\n<project xmlns="http://maven.apache.org/POM/4.0.0"><dependencies>\n'
    tail = "\n</dependencies></project>"
    texts = {
        head + dep + tail: 1, head + f"<!-- {dep} -->" + tail: 0, head + f"<!--\n{dep}\n-->\n{dep}" + tail: 1,
        head + f"<note><![CDATA[{dep}]]></note>" + tail: 0, head + dep.replace("1.60", "<![CDATA[1.60]]>") + tail: 1,
        head + dep: 0, head + dep + "<open>" + tail: 0, "": 0, "no xml at all": 0,
        f"<project><profiles><profile><dependencies>{dep}</dependencies></profile></profiles></project>": 1,
    }
    # ids of exclusions are not the dependency's own, wherever they stand
    inner = "<exclusions><exclusion><groupId>junit</groupId><artifactId>junit</artifactId></exclusion></exclusions>"
    other = "<groupId>g</groupId><artifactId>a</artifactId>"
    texts |= {
        head + dep.replace("<dependency>", "<dependency>" + inner) + tail: 1, head + dep.replace("</dependency>", inner + "</dependency>") + tail: 1,
        head + "<dependency>" + inner.replace("junit", "bcprov-jdk15on") + other + "</dependency>" + tail: 0,
        head + "<dependency><version>1</version><artifactId>\n bcprov-jdk15on </artifactId></dependency>" + tail: 1,
    }
    names = {f"m{i}/pom.xml": t for i, t in enumerate(texts)}
    got = detect_dependencies(files_df(*names.items())).collect()
    count = {n: sum(r.path == n for r in got) for n in names}
    assert {names[n]: c for n, c in count.items()} == texts


def test_first_emitted_shuffles_only_the_columns_asked_for(spark):
    """The same first rows as ``exact_dedup``; what nobody reads is in no exchange."""
    rows = spark.createDataFrame(
        [("s", "p", 1, "r", "late", "x" * 50, 2), ("s", "p", 1, "r", "first", "y" * 50, 1), ("s", "p", None, None, None, "z", 3)],
        "scan_id string, path string, line int, rule_id string, severity string, message string, emit_seq int")
    found = c.first_emitted(rows, "severity")
    assert found.columns == [*c.KEY, "severity"]
    assert sorted(map(str, found.collect())) == sorted(map(str, c.exact_dedup(rows).select(*found.columns).collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert all("message" not in line for line in plan.splitlines() if "Aggregate" in line)
