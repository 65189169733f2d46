"""Source, configuration and manifest files written from the orders table.

Each order becomes one file; its number picks the kind of file and fills the text. The
findings that kind must give are listed beside it and reach the comparison as SQL rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.plans.catalog import Tables

BITS = [512, 1024, 2048, 4096]
HARD = "Hardcoded key material"

# path, text, findings by layer: (line, rule, label, severity, confidence)
# {n} is the order number, {b} one of BITS
KINDS: list[tuple[str, str, dict[str, list[tuple]]]] = [
    ("src/m{n}.py", """import hashlib as hl
def login(password):
    return hl.md5(password.encode()).hexdigest()
def etag(body):
    return hl.sha1(body).hexdigest()
def safe(body):
    return hl.sha256(body).hexdigest()
""", {"python": [(3, "md5-weak-password-hash", "MD5", "Critical", "Likely"),
                 (5, "sha1-hashing", "SHA-1", "High", "Likely")]}),
    ("src/c{n}.py", """from Crypto.Cipher import AES, ARC4 as Old
KEY = b"0123456789abcdef"
ALIAS = KEY
iv_fixed = b"1234567890123456"
a = AES.new(ALIAS, AES.MODE_CBC, iv_fixed)
b = AES.new(load(), AES.MODE_ECB)
c = Old.new(load())
d = AES.new(load(), AES.MODE_GCM)
""", {"python": [(5, "aes-hardcoded-key", HARD, "Critical", "Likely"),
                 (5, "aes-static-iv-reuse", "Static/Reused IV", "High", "Likely"),
                 (5, "aes-missing-aead", "AES-128-CBC", "Critical", "Likely"),
                 (6, "aes-ecb-mode", "AES-ECB", "Critical", "Likely"),
                 (7, "arc4-deprecated-cipher", "ARC4", "Critical", "Likely"),
                 (8, "aes-aead-mode", "AES-GCM", "Informational", "Likely")],
      "entropy": [(2, "entropy-secret-high-confidence", HARD, "High", "Likely")]}),
    ("src/k{n}.py", """import random
from cryptography.hazmat.primitives.asymmetric import rsa, ec
k = rsa.generate_private_key(public_exponent=65537, key_size={b})
e = ec.generate_private_key(ec.SECP256R1())
def make_token(n):
    return "".join(random.choice("ab") for _ in range(n))
def check(token, other):
    if token == other:
        return True
    return len(token) == 3
""", {"python": [(3, "rsa-key-generation", "RSA-{b}", "RSA", "Likely"),
                 (4, "ecdsa-key-generation", "ECDSA (SECP256R1)", "Medium", "Likely"),
                 (6, "insecure-rng", "Non-CSPRNG", "High", "Likely"),
                 (8, "timing-unsafe-compare", "Variable-Time Comparison", "High", "Likely")]}),
    ("src/h{n}.py", """import hmac, hashlib
from cryptography.fernet import Fernet
SECRETS = load()
m = hmac.new(SECRETS, body, hashlib.sha1)
f = Fernet(SECRETS)
c = Cipher(
    algorithms.TripleDES(SECRETS),
    modes.CBC(iv)
)
d = dsa.generate_private_key(key_size={b})
""", {"python": [(4, "sha1-hmac-weak-digest", "SHA-1", "High", "Likely"),
                 (5, "fernet-aes128-cbc-hmac", "Fernet (AES-128-CBC+HMAC-SHA256)", "Low", "Likely"),
                 (6, "tripledes-deprecated-cipher", "TRIPLEDES-CBC", "Medium", "Likely"),
                 (10, "dsa-key-generation", "DSA-{b}", "DSA", "Likely")]}),
    ("src/auth{n}.js", """const crypto = require('crypto');
const key = 'abcdefghabcdefgh';
const c = crypto.createCipheriv('aes-256-cbc', key, Buffer.from('0000'));
const g = crypto.createCipheriv('aes-256-gcm', load(), iv);
const h = crypto.createHash('md5').update(password).digest('hex');
const s = crypto.createSign('SHA256');
function generateResetToken() {
  return Math.random().toString(36);
}
function verifyApiKey(provided, expected) {
  return provided === expected;
}
""", {"javascript": [(3, "aes-hardcoded-key", HARD, "Critical", "Likely"),
                     (3, "aes-static-iv-reuse", "Static/Reused IV", "High", "Likely"),
                     (3, "aes-missing-aead", "AES-256-CBC", "Critical", "Likely"),
                     (4, "aes-aead-mode", "AES-256-GCM", "Informational", "Likely"),
                     (5, "md5-weak-password-hash", "MD5", "Critical", "Likely"),
                     (6, "rsa-digital-signature-sign", "RSA-2048", "Medium", "Likely"),
                     (8, "insecure-rng", "Non-CSPRNG", "High", "Likely"),
                     (11, "timing-unsafe-compare", "Variable-Time Comparison", "High", "Likely")],
      "entropy": [(2, "entropy-secret-name-hint-only", HARD, "Medium", "Possible")]}),
    ("web/lib{n}.js", """const a = CryptoJS.TripleDES.encrypt(x, y);
const b = CryptoJS.MD5(x);
const s = new KJUR.crypto.Signature({"alg": "SHA1withRSA"});
const p = crypto.generateKeyPairSync('rsa', {
  modulusLength: {b}
});
const q = crypto.generateKeyPairSync('ec', { namedCurve: 'P-256' });
const d = crypto.createCipheriv('des-ede3-cbc', load(), iv);
""", {"javascript": [(1, "cryptojs-tripledes-cipher", "3DES/DES", "High", "Likely"),
                     (2, "cryptojs-md5-hash", "MD5", "Critical", "Likely"),
                     (3, "jsrsasign-sha1withrsa-weak-signature", "SHA1withRSA", "High", "Likely"),
                     (4, "rsa-key-generation", "RSA-{b}", "RSA", "Likely"),
                     (7, "ecdsa-key-generation", "ECDSA (P-256)", "Medium", "Likely"),
                     (8, "des-deprecated-cipher", "DES", "Critical", "Likely")]}),
    ("svc{n}/Dockerfile", """FROM base:{n}
ENV HASH_ALGO=md5
ENV DB_PASSWORD=hunter2secret
RUN curl -k https://host/{n}
ARG API_TOKEN=changeme
""", {"config": [(2, "config-weak-algorithm", "MD5", "Critical", "Possible"),
                 (3, "dockerfile-hardcoded-secret", HARD, "High", "Possible"),
                 (4, "tls-verification-disabled", "Disabled TLS verification", "Critical", "Possible")]}),
    ("cfg{n}/.env", """# order {n}
API_KEY=abcd1234efgh # note
CIPHER=aes-ecb
password=${PW}
""", {"config": [(2, "config-plaintext-secret", HARD, "High", "Possible"),
                 (3, "config-weak-algorithm", "ECB Mode", "Critical", "Possible")],
      "entropy": [(2, "entropy-secret-name-hint-only", HARD, "Medium", "Possible")]}),
    ("conf{n}/app.yml", """verify: false
algorithm: "des"
api_key: 'abcdefg'
mode: gzip
password: ${X}
""", {"config": [(1, "tls-verification-disabled", "Disabled TLS verification", "Critical", "Possible"),
                 (2, "config-weak-algorithm", "3DES/DES", "Critical", "Possible"),
                 (3, "config-plaintext-secret", HARD, "High", "Possible")]}),
    ("conf{n}/db.ini", """[db]
cipher = rc4 ; old
secret_key = abcdefghijk
""", {"config": [(2, "config-weak-algorithm", "RC4", "Critical", "Possible"),
                 (3, "config-plaintext-secret", HARD, "High", "Possible")],
      "entropy": [(3, "entropy-secret-name-hint-only", HARD, "Medium", "Possible")]}),
    ("etc{n}/nginx.conf", """server {
  ssl_protocols TLSv1 TLSv1.1 TLSv1.2;
  ssl_ciphers RC4:MD5:!aNULL;
}
""", {"infra": [(2, "infra-weak-tls-protocol", "TLS/SSL", "High", "Likely"),
                (3, "infra-weak-cipher-suite", "Cipher Suite", "High", "Likely")]}),
    ("deploy{n}/main.tf", """resource "x" "y" {
  db_password = "supersecret{n}"
  key = "var.key"
}
""", {"infra": [(2, "infra-terraform-hardcoded-secret", "Plaintext Secret", "High", "Possible")]}),
    ("k8s{n}/s.yaml", """apiVersion: v1
kind: Secret
data:
  pw: c2VjcmV0cHc=
stringData:
  tok: abcdefg
---
kind: ConfigMap
data:
  a: bbbbbb
""", {"infra": [(4, "infra-k8s-secret-plaintext", "Plaintext Secret", "High", "Possible"),
                (6, "infra-k8s-secret-plaintext", "Plaintext Secret", "High", "Possible")]}),
    ("pkg{n}/package.json", """{
"dependencies": {"md5": "^2.0.0", "jsonwebtoken": "^8.5.{n}"},
"devDependencies": {"node-rsa": "1.0"}
}
""", {"manifest": [(2, "sca-npm-md5", "MD5", "High", "Likely"),
                   (2, "sca-npm-jsonwebtoken", "JWT", "Medium", "Likely"),
                   (3, "sca-npm-node-rsa", "RSA", "Medium", "Likely")]}),
    ("req{n}/requirements.txt", """rsa==4.{n}
py-crypto>=2
# order {n}
cryptography>=3 # c
""", {"manifest": [(1, "sca-pip-rsa", "RSA", "Medium", "Likely"),
                   (2, "sca-pip-pycrypto", "Legacy Crypto", "Critical", "Likely"),
                   (4, "sca-pip-cryptography", "General Crypto", "Informational", "Likely")]}),
    ("mvn{n}/pom.xml", """<project>
<dependency><groupId>org.bouncycastle</groupId>
<artifactId>bcprov-jdk15on</artifactId><version>1.{n}</version></dependency>
</project>
""", {"manifest": [(3, "sca-maven-bcprov-jdk15on", "BouncyCastle", "Informational", "Likely")]}),
    ("old/p{n}.py", """from Crypto.Cipher import DES, DES3, ARC2 as RC2, ARC4 as RC4, Blowfish as BF, AES
import hashlib as h
a = DES.new(load(), DES.MODE_ECB)
b = DES3.new(load(), mode=DES3.MODE_CBC)
c = BF.new(f(g(h2(i(j({n}))))), BF.MODE_CTR)
d = RC4.new(load())
e = h.new(
    'MD5', body)
g = AES.new(load(), AES.MODE_SIV)
k = AES.new(f(g(h2(i(j({n}))))), AES.MODE_ECB)
x = \'\'\'
DES.new(load(), DES.MODE_ECB)
\'\'\'
y = "hashlib.md5(x)"  # hashlib.md5(x)
""", {"python": [(3, "des-deprecated-cipher", "DES-ECB", "Critical", "Likely"),
                 (4, "des3-deprecated-cipher", "DES3-CBC", "Critical", "Likely"),
                 (5, "blowfish-deprecated-cipher", "BLOWFISH-CTR", "Critical", "Likely"),
                 (6, "arc4-deprecated-cipher", "ARC4", "Critical", "Likely"),
                 (7, "md5-hashing", "MD5", "Critical", "Likely"),
                 (9, "aes-encryption", "AES-SIV", "Medium", "Likely"),
                 (10, "aes-ecb-mode", "AES-ECB", "Critical", "Likely")]}),
    ("old/g{n}.py", """import random as rnd, rsa, hmac, hashlib
k = RSA.generate({b})
n, m = rsa.newkeys({b})
d = DSA.generate({b})
c = Cipher(algorithms.AES(key), modes.ECB())
e = Cipher(algorithms.AES(b'0123456789abcdef'), modes.CBC(iv))
f = Cipher(algorithms.AES(key), mode=modes.GCM(nonce))
w = hmac.new(pick(), body, digestmod='md5')
v = hmac.new(pick(), body, hashlib.sha256)
def make_token():
    def inner():
        return rnd.choice("ab")
    return rnd.sample("ab", {n})
if True:
    rnd.seed({n})
ok = token == a == b
fine = len(token) == {n} and token is None
bad = token != other
""", {"python": [(2, "rsa-key-generation", "RSA-{b}", "RSA", "Likely"),
                 (3, "rsa-key-generation", "RSA-{b}", "RSA", "Likely"),
                 (4, "dsa-key-generation", "DSA-{b}", "DSA", "Likely"),
                 (5, "aes-ecb-mode", "AES-ECB", "Critical", "Likely"),
                 (6, "aes-missing-aead", "AES-128-CBC", "Medium", "Likely"),
                 (7, "aes-aead-mode", "AES-GCM", "Informational", "Likely"),
                 (8, "md5-hmac-weak-digest", "MD5", "Critical", "Likely"),
                 (13, "insecure-rng", "Non-CSPRNG", "High", "Likely"),
                 (18, "timing-unsafe-compare", "Variable-Time Comparison", "High", "Likely")]}),
    ("web/sig{n}.js", """const s = crypto.createSign('ecdsa-with-SHA256');
const v = crypto.createVerify('RSA-SHA256');
const w = createVerify('EC-SHA{n}');
const a = CryptoJS.RC4.encrypt(x, y);
const b = CryptoJS.DES.encrypt(x, y);
const c = CryptoJS.SHA1(f(g(h(i(j(x))))));
const g = new KJUR.crypto.Signature({"alg": "MD5withRSA"});
const t = "CryptoJS.MD5(x)"; // CryptoJS.MD5(x)
/* crypto.createHash('md5') */ const r = /CryptoJS.MD5(x)/;
const ALGO = 'sha1';
const h = crypto.createHash('sha1').update(`${CryptoJS}`);
const makeToken = async (n) => { return Math.random().toString(n); };
function makeSecret() { return 1; }
const plain = Math.random();
""", {"javascript": [(1, "ecdsa-signature-sign", "ECDSA (secp256k1)", "Medium", "Likely"),
                     (2, "rsa-digital-signature-verify", "RSA-2048", "Medium", "Likely"),
                     (3, "ecdsa-signature-verify", "ECDSA (secp256k1)", "Medium", "Likely"),
                     (4, "cryptojs-rc4-stream-cipher", "RC4", "Critical", "Likely"),
                     (5, "cryptojs-des-cipher", "DES", "Critical", "Likely"),
                     (6, "cryptojs-sha1-hash", "SHA-1", "High", "Likely"),
                     (7, "jsrsasign-md5withrsa-weak-signature", "MD5withRSA", "Critical", "Likely"),
                     (11, "sha1-hashing", "SHA-1", "High", "Likely"),
                     (12, "insecure-rng", "Non-CSPRNG", "High", "Likely")]}),
    ("etc{n}/httpd.conf", """# SSLProtocol SSLv3
<VirtualHost *:{n}>
  SSLProtocol all -SSLv2 +TLSv1
  SSLCipherSuite HIGH:RC4:!MD5
  SSLProtocol TLSv1.2 TLSv1.3
</VirtualHost>
""", {"infra": [(3, "infra-weak-tls-protocol", "TLS/SSL", "High", "Likely"),
                (4, "infra-weak-cipher-suite", "Cipher Suite", "High", "Likely")]}),
    ("etc{n}/haproxy.conf", """global
  ssl-default-bind-ciphers ECDHE-RSA-AES256-GCM-SHA384:DES-CBC3-SHA
  ssl-default-bind-options ssl-min-ver TLSv1.0
frontend f{n}
""", {"infra": [(2, "infra-weak-cipher-suite", "Cipher Suite", "High", "Likely"),
                (3, "infra-weak-tls-protocol", "TLS/SSL", "High", "Likely")]}),
    ("mvn{n}/near/pom.xml", """<project>
<!-- <dependency><groupId>org.bouncycastle</groupId><artifactId>bcprov-jdk15on</artifactId></dependency> -->
<note><![CDATA[<dependency><artifactId>bcprov-jdk15on</artifactId></dependency>]]></note>
<dependency><groupId>com.example</groupId><artifactId>other{n}</artifactId></dependency>
</project>
""", {}),
    ("src/broken{n}.py", """import hashlib
def f(:
    return hashlib.md5(x{n})
""", {}),
    ("req{n}/dev/requirements.txt", """# rsa==4.{n}
requests>=2
-r other.txt
rsa-extra==1
M2Crypto==0.{n}
""", {}),
]

# sites where two layers report one secret: what is left of them after the merge
MERGED = {
    (7, 2): ("entropy-secret-name-hint-only", HARD, "High", "Confirmed"),
    (9, 3): ("entropy-secret-name-hint-only", HARD, "High", "Confirmed"),
}


def source_files(t: Tables) -> DataFrame:
    """(scan_id, repo_id, path, text): one file per order."""
    n = F.col("o_orderkey").cast("string")
    kind = (F.col("o_orderkey") % len(KINDS)).cast("int")
    bits = F.element_at(F.array(*[F.lit(str(b)) for b in BITS]), (F.col("o_custkey") % 4 + 1).cast("int"))

    def fill(texts: list[str]):
        picked = F.element_at(F.array(*[F.lit(x) for x in texts]), kind + 1)
        return F.replace(F.replace(picked, F.lit("{n}"), n), F.lit("{b}"), bits)

    return t.wide("orders").select(
        n.alias("scan_id"), F.col("o_custkey").cast("string").alias("repo_id"),
        fill([k[0] for k in KINDS]).alias("path"), fill([k[1] for k in KINDS]).alias("text"))


def _rows(layers: list[str] | None) -> list[tuple]:
    out = []
    for kind, (_, _, by_layer) in enumerate(KINDS):
        for layer, found in by_layer.items():
            if layers is None or layer in layers:
                out += [(kind, *row) for row in found]
    return out


def _merged_rows() -> list[tuple]:
    kept = [r for r in _rows(None) if (r[0], r[1]) not in MERGED]
    return kept + [(kind, line, *rest) for (kind, line), rest in MERGED.items()]


def merged_rules() -> set[tuple[int, str]]:
    """Rules that each kind of file must give after the merge."""
    return {(r[0], r[2]) for r in _merged_rows()}


def expected_sql(layers: list[str] | None = None, merged: bool = False) -> str:
    """Expected findings as SQL over orders."""
    rows = _merged_rows() if merged else _rows(layers)
    values = ", ".join(
        "(" + ", ".join(str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in row) + ")"
        for row in rows)
    paths = ", ".join(f"'{k[0]}'" for k in KINDS)
    bits = ", ".join(map(str, BITS))
    return f"""
WITH expected AS (SELECT * FROM (VALUES {values}) v(kind, line, rule_id, algorithm, severity, confidence)),
files AS (SELECT CAST(o_orderkey AS VARCHAR) AS scan_id, o_orderkey % {len(KINDS)} AS kind,
  replace(([{paths}])[o_orderkey % {len(KINDS)} + 1], '{{n}}', CAST(o_orderkey AS VARCHAR)) AS path,
  ([{bits}])[o_custkey % 4 + 1] AS bits FROM orders)
SELECT scan_id, path, line, rule_id, replace(algorithm, '{{b}}', CAST(bits AS VARCHAR)) AS algorithm,
  CASE severity WHEN 'RSA' THEN CASE WHEN bits < 1024 THEN 'Critical' WHEN bits < 2048 THEN 'High' ELSE 'Medium' END
    WHEN 'DSA' THEN CASE WHEN bits < 2048 THEN 'High' ELSE 'Medium' END ELSE severity END AS severity, confidence
FROM files JOIN expected USING (kind)"""
