"""Vocabularies, lookup tables, thresholds and patterns.

Results depend on these exact values, so they are stated once, as plain text.
Everything else in the package is column logic that reads them.
"""

# --- Fixed values: severity, risk and confidence vocabularies -----------------
SEVERITY_RANK = {"Critical": 4, "High": 3, "Medium": 2, "Low": 1, "Informational": 0}
SEVERITY_WEIGHT = {
    "CRITICAL": 100, "HIGH": 75, "MEDIUM": 50, "LOW": 25, "INFORMATIONAL": 0, "INFO": 0,
}
SEVERITY_LADDER = ["Informational", "Low", "Medium", "High", "Critical"]
CLASSICAL = "Classical Risk"
BROKEN = "Quantum-Broken"
WEAKENED = "Quantum-Weakened"
SAFE = "Safe"

# --- Fixed values: directories that are never scanned -------------------------
PRUNED_DIRS = [
    "node_modules", ".git", "venv", ".venv", "__pycache__", "vendor", "vendors",
    "bower_components", "dist", "build",
]
PRUNED_DIRS_CLI = ["node_modules", ".git", "__pycache__", "venv", ".venv", "dist", "build"]

# --- Fixed values: names that hint at a secret --------------------------------
SINGLE_SECRET_HINTS = [
    "secret", "privkey", "password", "passwd", "apikey", "token", "auth", "key", "pass",
    "credential", "cert", "seed", "signature", "sig", "mac", "digest",
]
COMPOUND_SECRET_HINTS = [
    "private_key", "priv_key", "api_key", "auth_token", "access_token", "signing_key",
    "encryption_key", "aes_key", "des_key", "hmac_key", "bearer_token", "client_secret",
    "db_pass", "db_password", "master_password", "stripe_key", "webhook_key",
    "private_token", "expected_signature", "provided_signature",
]

# --- Fixed values: placeholders and false-positive shapes ---------------------
PLACEHOLDERS = [
    "", "changeme", "your-secret-here", "xxx", "<secret>", "todo", "fixme", "example",
    "replace_me", "insert_secret_here", "password", "secret", "your_password_here",
]
PLACEHOLDERS_CONFIG_EXTRA = ["dummy", "test"]
PLACEHOLDER_SHAPE = r"^\$\{[^}]*\}$|^%[^%]+%$|^\{\{[^}]+\}\}$|^\$\([^)]+\)$"
PLACEHOLDER_SHAPE_CONFIG = PLACEHOLDER_SHAPE + r"|^<[^>]+>$"
VERSION_SHAPE = r"(?i)^\d+\.\d+(?:\.\d+)?(?:[.-][a-z0-9]++)*+$"
URL_SHAPE = r"(?i)^https?://[^\s]+$"
URL_WITH_LOGIN_SHAPE = r"(?i)^https?://[^@/]*:[^@/]*@"
PATH_SHAPE = r"^(?:/[^/\s]++)++/?$|^[A-Za-z]:\\[^\s]+$"
UUID_SHAPE = (
    r"(?i)^[{(]?[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}[})]?$"
)

# --- Fixed values: entropy thresholds -----------------------------------------
ENTROPY_THRESHOLD = 4.0
MIN_SECRET_LEN = 16
MIN_NAME_HINT_LEN = 8

# --- Fixed values: algorithm names --------------------------------------------
NON_CRYPTO_ALGORITHMS = [
    "gzip", "zstd", "snappy", "lz4", "deflate", "bzip2", "br", "brotli", "lzo", "none", "raw",
    "null", "plain", "round-robin", "least-connections", "random", "linear", "binary",
    "dijkstra", "astar", "kmeans", "pca", "auto", "default", "lru", "lfu", "fifo",
]
STRONG_ALGORITHMS = [
    "sha256", "sha-256", "sha3", "sha-3", "sha384", "sha-384", "sha512", "sha-512", "aes-gcm",
    "aes-256-gcm", "aes-128-gcm", "chacha20-poly1305", "poly1305", "ml-kem", "ml-dsa",
    "slh-dsa", "ed25519", "x25519", "argon2", "argon2id", "bcrypt", "scrypt",
    "pbkdf2-sha256", "pbkdf2-sha512",
]
OTHER_ALGORITHM_NAMES = [
    "md5", "md4", "md2", "sha1", "sha-1", "des", "3des", "des3", "tripledes", "tdes", "rc2",
    "rc4", "arc4", "blowfish", "cast5", "idea", "aes", "aes-128", "aes-256", "aes-cbc",
    "aes-ecb", "rsa", "dsa", "ecdh", "ecdsa", "ecc",
]

# label, rule name, category, severity, recommendation, whole-value names, first-token names
WEAK_CONFIG_ALGORITHMS = [
    ("MD5", "Weak Hash Algorithm Configured", "hash", "Critical",
     "MD5 is broken by collision attacks. Replace with SHA-256 or SHA-3.",
     ["md5", "md4", "md2"], ["md5", "md4", "md2"]),
    ("SHA-1", "Weak Hash Algorithm Configured", "hash", "High",
     "SHA-1 has known collision attacks. Replace with SHA-256 or SHA-3.",
     ["sha1", "sha-1"], ["sha1", "sha-1"]),
    ("RIPEMD-160", "Legacy Hash Algorithm Configured", "hash", "Medium",
     "Replace RIPEMD with SHA-256 or SHA-3.",
     ["ripemd160", "ripemd"], ["ripemd160", "ripemd"]),
    ("3DES/DES", "Weak Legacy Cipher Configured", "symmetric-cipher", "Critical",
     "DES/3DES is deprecated with small 64-bit block size (Sweet32 attack). "
     "Replace with AES-256-GCM.",
     ["des", "3des", "des3", "tripledes", "tdes"], ["des", "3des", "des3", "tripledes", "tdes"]),
    ("RC4", "Broken Stream Cipher Configured", "symmetric-cipher", "Critical",
     "RC4 stream cipher is cryptographically broken. "
     "Replace with AES-256-GCM or ChaCha20-Poly1305.",
     ["rc4", "arc4", "rc2", "arc2"], ["rc4", "arc4", "rc2"]),
    ("Blowfish/Legacy", "Legacy Cipher Configured", "symmetric-cipher", "High",
     "Legacy ciphers with small block sizes are vulnerable to collision attacks. "
     "Migrate to AES-256-GCM.",
     ["blowfish", "cast5", "idea"], ["blowfish", "cast5", "idea"]),
]
ECB_CONFIG = (
    "ECB Mode", "Insecure ECB Cipher Mode Configured", "symmetric-cipher", "Critical",
    "ECB mode leaks plaintext structure. Switch to AES-256-GCM or AES-256-CBC with HMAC.",
)

# --- Fixed values: call-site profiles -----------------------------------------
# key -> label, severity, quantum risk, recommendation
HASH_PROFILES = {
    "md5": ("MD5", "Critical", CLASSICAL,
            "Replace MD5 with SHA-256/SHA-3. If used for password storage, use a memory-hard "
            "KDF (argon2id, scrypt, bcrypt) instead of a raw hash."),
    "sha1": ("SHA-1", "High", CLASSICAL,
             "SHA-1 has known collision attacks. Replace with SHA-256 or SHA-3-256."),
    "sha256": ("SHA-256", "Informational", SAFE,
               "SHA-256 is strong and quantum-safe against Shor's algorithm."),
    "sha3": ("SHA-3", "Informational", SAFE, "SHA-3 is strong and quantum-safe."),
    "sha512": ("SHA-512", "Informational", SAFE, "SHA-512 is strong and quantum-safe."),
}
BROKEN_CIPHERS = ["DES", "3DES", "DES3", "TDES", "RC2", "RC4", "ARC4", "BLOWFISH"]
AEAD_MODES = ["GCM", "CCM", "POLY1305", "CHACHA20-POLY1305", "OCB"]
UNAUTHENTICATED_MODES = ["CBC", "CTR", "CFB", "OFB"]
REC_BROKEN_CIPHER = (
    " is deprecated/broken by classical cryptanalysis or has too small a block/key size. "
    "Replace with AES-256-GCM."
)
REC_ECB = (
    "ECB mode leaks plaintext structure (identical blocks encrypt identically). "
    "Switch to AES-256-GCM or AES-256-CBC+HMAC."
)
REC_AEAD_SHORT = (
    "AEAD mode in use - good. Use a 256-bit key to keep full margin against Grover's algorithm."
)
REC_AEAD_OK = "No action needed."
REC_UNAUTHENTICATED = (
    " mode provides no built-in integrity/authentication. Prefer AES-256-GCM. If CBC must be "
    "kept, pair it with a separate encrypt-then-MAC (HMAC-SHA-256)."
)
REC_VERIFY_MODE = (
    "Verify this cipher mode provides authenticated encryption; prefer AES-256-GCM."
)
REC_RED_FLAGS = "lack of authenticated encryption makes this call exploitable. "
REC_RSA_SHORT = (
    "Key size is below the classically-safe 2048-bit minimum - raise it immediately. But note "
    "raising key size alone does not fix quantum exposure: "
)
REC_RSA = (
    "RSA is broken by Shor's algorithm at any key size. Migrate to ML-KEM (key exchange) and/or "
    "ML-DSA (signatures) as NIST's standardized PQC replacements, or use a hybrid classical+PQC "
    "scheme during transition."
)
REC_ECC = (
    "Broken by Shor's algorithm regardless of curve size. Migrate signatures to ML-DSA (or "
    "SLH-DSA for a stateless hash-based fallback) and key exchange to ML-KEM, or use a hybrid "
    "classical+PQC construction during transition."
)
REC_DSA = (
    "DSA is broken by Shor's algorithm and weak when key size < 2048. "
    "Migrate to ML-DSA (FIPS 204)."
)
INSECURE_RNG = ("Non-CSPRNG", "High", CLASSICAL,
                "This value feeds a security-sensitive operation (key/IV/token/nonce) but is drawn "
                "from a non-cryptographic PRNG (random/Math.random). Attackers can predict its "
                "output. Use os.urandom(), secrets.token_bytes(), or crypto.randomBytes().")
TIMING_COMPARE = ("Variable-Time Comparison", "High", CLASSICAL,
                  "Byte-by-byte equality ('==' or '!==') on signatures, hashes, MACs, or tokens "
                  "leaks execution time proportional to the first mismatched byte, allowing "
                  "forgery via timing oracle. Use hmac.compare_digest() (Python) or "
                  "crypto.timingSafeEqual() (Node.js).")
HARDCODED_KEY = ("Hardcoded key material", "Critical", CLASSICAL,
                 "Key/secret material is embedded as a literal in source. Anyone with source or "
                 "repo access recovers it. Load from a secrets manager / KMS / environment "
                 "variable injected at deploy time, and rotate this key immediately.")
STATIC_IV = ("Static/Reused IV", "High", CLASSICAL,
             "Static, hardcoded, or zeroed IVs destroy confidentiality and allow replay/tampering "
             "attacks. Generate a fresh cryptographic random IV for each encryption operation "
             "using crypto.randomBytes() or os.urandom().")
FERNET = ("Fernet (AES-128-CBC+HMAC-SHA256)", "Low", WEAKENED,
          "Fernet is authenticated (AES-128-CBC + HMAC-SHA256) so it isn't broken, but its 128-bit "
          "key gives a smaller post-quantum margin than AES-256-GCM. Prefer AES-256-GCM directly "
          "for new code with long-lived confidentiality needs.")

PY_HASH_CALLS = [
    "hashlib.md5", "md5", "hashlib.sha1", "sha1", "hashlib.sha256", "sha256",
    "hashlib.sha3_256", "sha3_256", "hashlib.sha512", "sha512",
]
PY_CIPHER_HEADS = [
    "AES", "DES", "DES3", "TDES", "RC2", "RC4", "ARC4", "Blowfish", "Crypto", "Cryptodome",
]
PY_LEGACY_CIPHERS = ["DES", "DES3", "TDES", "RC2", "RC4", "ARC4", "Blowfish"]
PY_COMPOSED_LEGACY = ["TRIPLEDES", "3DES", "DES", "BLOWFISH", "ARC4", "RC4"]
PY_RANDOM_CALLS = [
    "random.random", "random.randint", "random.choice", "random.getrandbits",
    "random.randrange", "random.sample", "random.seed",
]
PY_RANDOM_BYTE_CALLS = [
    "os.urandom", "urandom", "secrets.token_bytes", "secrets.token_hex", "get_random_bytes",
    "Random.get_random_bytes",
]
JS_LEGACY_CIPHERS = ["DES", "DES-EDE3", "DES3", "RC4", "ARC4", "3DES", "RC2", "BF", "BLOWFISH"]
NON_SECRET_PROPS = ["length", "len", "size", "count", "index"]
# marker in the upper-cased call name -> rule, name, category, label, severity, risk, advice,
# specificity; the first marker that is present wins
JS_LIBRARY_CALLS = [
    (["RC4"], "cryptojs-rc4-stream-cipher", "CryptoJS RC4 stream cipher", "stream-cipher",
     "RC4", "Critical", CLASSICAL,
     "RC4 stream cipher is cryptographically broken. Migrate to AES-256-GCM or "
     "ChaCha20-Poly1305.", 3),
    (["TRIPLEDES", "3DES"], "cryptojs-tripledes-cipher",
     "CryptoJS TripleDES symmetric encryption", "symmetric-cipher", "3DES/DES", "High", CLASSICAL,
     "Triple-DES has 64-bit blocks vulnerable to Sweet32. Migrate to AES-256-GCM.", 3),
    (["DES"], "cryptojs-des-cipher", "CryptoJS DES symmetric encryption", "symmetric-cipher",
     "DES", "Critical", CLASSICAL,
     "DES has an obsolete 56-bit key size. Migrate to AES-256-GCM.", 3),
    (["MD5"], "cryptojs-md5-hash", "CryptoJS MD5 hashing", "hash",
     *HASH_PROFILES["md5"], 2),
    (["SHA1"], "cryptojs-sha1-hash", "CryptoJS SHA-1 hashing", "hash",
     *HASH_PROFILES["sha1"], 2),
]
JS_SIGNATURE_SHA1 = ("SHA1withRSA", "High", BROKEN,
                     "SHA1withRSA uses collision-weak SHA-1 and classical RSA. Migrate to ML-DSA "
                     "(FIPS 204) or ECDSA with SHA-256.")
JS_SIGNATURE_MD5 = ("MD5withRSA", "Critical", BROKEN,
                    "MD5withRSA uses broken MD5 hash and classical RSA. "
                    "Migrate to ML-DSA (FIPS 204).")

# --- Fixed values: disabled certificate checks (pattern, label) ---------------
TLS_DISABLED = [
    (r"(?i)NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*[\"']?0[\"']?", "NODE_TLS_REJECT_UNAUTHORIZED=0"),
    (r"(?i)\bcurl\b[^\n]*(?:-k\b|--insecure\b)", "curl --insecure"),
    (r"(?i)\bwget\b[^\n]*--no-check-certificate\b", "wget --no-check-certificate"),
    (r"(?i)\bpip\b[^\n]*--trusted-host\b", "pip --trusted-host"),
    (r"(?i)\b(?:verify|ssl|rejectUnauthorized|tls_verify)\s*:\s*false\b", "TLS verify disabled"),
    (r"(?i)\bInsecureSkipVerify\s*:\s*true\b", "InsecureSkipVerify: true"),
]

# --- Fixed values: web server, Terraform and cluster-secret patterns ----------
WEAK_PROTOCOL = r"(?i)\b(?:SSLv2|SSLv3|TLSv1\.0|TLSv1\.1|TLSv1(?![.\d]))\b"
WEAK_CIPHER = r"(?i)\b(RC4|DES|3DES|DES-CBC3|MD5|NULL|EXPORT|ADH|AECDH)\b"
PROTOCOL_DIRECTIVES = [
    r"(?i)^\s*ssl_protocols\s+([^;]+);",
    r"(?i)^\s*SSLProtocol\s+(.+)$",
    r"(?i)^\s*(?:ssl-default-bind-options|options)\s+([^#\n]+)",
]
CIPHER_DIRECTIVES = [
    r"(?i)^\s*ssl_ciphers\s+([^;]+);",
    r"(?i)^\s*SSLCipherSuite\s+(.+)$",
    r"(?i)^\s*(?:ssl-default-bind-ciphers|ciphers)\s+([^#\n]+)",
]
WEB_SERVER_FILES = [
    "nginx.conf", "httpd.conf", "apache2.conf", "ssl.conf", "haproxy.cfg", "haproxy.conf",
]
WEB_SERVER_PATH_HINTS = [
    "nginx", "apache", "haproxy", "sites-available", "sites-enabled", "conf.d", "infra",
    "server", "web", "ssl",
]
TERRAFORM_LITERAL = r'^[ \t]*([A-Za-z0-9_\-]+)[ \t]*=[ \t]*"([^"$][^"]*)"'

# --- Fixed values: generic line rules (id, name, category, severity, quantum, pattern, advice)
LINE_RULES = [
    ("CRYPTO-RULE-RSA-SHORT", "RSA Short Key Usage (< 2048-bit)", "Asymmetric Key Length",
     "critical", "yes",
     r"(?i)(?:RSA\.generate\(\s*(?:512|1024)|key_size\s*=\s*(?:512|1024)|generate_private_key\([^)]*1024)",
     "Migrate to NIST ML-DSA or minimum RSA-3072 bit key."),
    ("CRYPTO-RULE-MD5-BROKEN", "MD5 Cryptographically Broken Hash", "Broken Hash Function",
     "critical", "no",
     r"(?i)(?:createHash\(\s*['\"]md5['\"]|hashlib\.md5|MessageDigest\.getInstance\(\s*[\"']MD5[\"']|MD5_Init|crypto\.md5)",
     "Replace MD5 with collision-resistant SHA-256 or SHA-3."),
    ("CRYPTO-RULE-SHA1-DEP", "SHA-1 Deprecated Hash Function", "Deprecated Hash", "high", "no",
     r"(?i)(?:createHash\(\s*['\"]sha1['\"]|hashlib\.sha1|MessageDigest\.getInstance\(\s*[\"']SHA-?1[\"']|SHA1_Init)",
     "Upgrade to SHA-256 or SHA-512."),
    ("CRYPTO-RULE-DES-WEAK", "DES / 3DES Deprecated Cipher", "Weak Block Cipher", "high", "no",
     r"(?i)(?:des\.NewCipher|DES_ecb_encrypt|Cipher\.getInstance\(\s*[\"']DES|CryptoJS\.DES|TripleDES)",
     "Migrate to AES-256-GCM."),
    ("CRYPTO-RULE-ECDSA-CLASSIC", "Classical ECDSA / ECDH (Quantum-Vulnerable)",
     "Post-Quantum Risk", "high", "yes",
     r"(?i)(?:secp256k1|secp256r1|prime256v1|SECP256R1|crypto\.createECDH|EC_KEY_new_by_curve_name)",
     "Implement NIST PQC hybrid key exchange (ML-KEM-768)."),
    ("CRYPTO-RULE-AES-CBC-PADDING", "AES in CBC Mode with PKCS#7 Padding",
     "Padding Oracle Risk", "medium", "no",
     r"(?i)(?:AES/CBC/PKCS5Padding|AES/CBC/PKCS7Padding|modes\.CBC|Cipher\.AES_CBC)",
     "Switch to Authenticated Encryption (AES-GCM)."),
    ("CRYPTO-ASSET-AES-GCM", "AES-256-GCM Authenticated Encryption", "Modern Symmetric Cipher",
     "info", "safe",
     r"(?i)(?:AES-256-GCM|AES/GCM/NoPadding|modes\.GCM|aes-256-gcm)",
     "Compliant with FIPS 140-3."),
]

# every line rule needs at least one of these words, in lower case
LINE_RULE_WORDS = [
    "rsa.generate(", "key_size", "generate_private_key(", "createhash(", "hashlib.",
    "messagedigest.", "md5_init", "crypto.md5", "sha1_init", "des.newcipher", "des_ecb_encrypt",
    "cipher.", "cryptojs.des", "tripledes", "secp256", "prime256v1", "createecdh",
    "ec_key_new_by_curve_name", "aes/cbc/", "modes.", "aes-256-gcm", "aes/gcm/",
]

# --- Fixed values: how specific each rule is when layers agree on one secret --
RULE_QUALITY = {
    "infra-k8s-secret-plaintext": 120,
    "infra-terraform-hardcoded-secret": 115,
    "aes-hardcoded-key": 110,
    "entropy-secret-high-confidence": 100,
    "entropy-secret-high-entropy-only": 80,
    "entropy-secret-name-hint-only": 60,
    "dockerfile-hardcoded-secret": 50,
    "config-plaintext-secret": 40,
    "tls-verification-disabled": 35,
}
RULE_QUALITY_DEFAULT = 30

# --- Fixed values: dependency catalogue ---------------------------------------
# ecosystem, library, purpose, algorithms, severity, quantum risk, note, minimum safe version,
# recommendation
LIBRARIES = [
    ("npm", "crypto-js", "symmetric-cipher",
     ["General Crypto", "AES", "MD5", "SHA-1", "RC4", "Rabbit"], "Low", CLASSICAL,
     "General crypto utility library — audit which primitives are actually used.", None,
     "Audit cipher modes and key sizes used via crypto-js; prefer standard Web Crypto API or "
     "AES-256-GCM."),
    ("npm", "md5", "hash", ["MD5"], "High", CLASSICAL, None, None,
     "Replace MD5 with SHA-256 or SHA-3."),
    ("npm", "node-rsa", "asymmetric", ["RSA"], "Medium", BROKEN, None, None,
     "Plan migration to ML-KEM/ML-DSA (FIPS 203/204)."),
    ("npm", "jsrsasign", "asymmetric", ["RSA", "ECDSA"], "Medium", BROKEN, None, None,
     "Plan migration to ML-KEM/ML-DSA (FIPS 203/204)."),
    ("npm", "elliptic", "asymmetric", ["ECDSA", "ECDH"], "Medium", BROKEN, None, None,
     "Plan migration to ML-KEM/ML-DSA (FIPS 203/204)."),
    ("npm", "jsonwebtoken", "signature", ["JWT"], "Low", CLASSICAL,
     "Verify 'alg' is never set to 'none' and HS256 secrets are high-entropy.", "9.0.0",
     "Upgrade to jsonwebtoken >= 9.0.0 and enforce strong asymmetric or HMAC algorithms."),
    ("npm", "des.js", "symmetric-cipher", ["DES", "3DES"], "Critical", CLASSICAL, None, None,
     "des.js implements deprecated DES/3DES ciphers with 64-bit blocks. Migrate to AES-256-GCM."),
    ("npm", "rc4", "stream-cipher", ["RC4"], "Critical", CLASSICAL, None, None,
     "RC4 stream cipher is cryptographically broken. Migrate to AES-256-GCM or "
     "ChaCha20-Poly1305."),
    ("npm", "blowfish", "symmetric-cipher", ["Blowfish"], "High", CLASSICAL, None, None,
     "Blowfish has a 64-bit block size vulnerable to Sweet32 birthday attacks. Migrate to "
     "AES-256-GCM."),
    ("npm", "bcryptjs", "kdf", ["bcrypt"], "Informational", SAFE,
     "Password hashing library — secure against classical attacks.", None,
     "Ensure appropriate work factor (cost >= 12) is configured."),
    ("npm", "bcrypt", "kdf", ["bcrypt"], "Informational", SAFE,
     "Native password hashing library — secure against classical attacks.", None,
     "Ensure appropriate work factor (cost >= 12) is configured."),
    ("pip", "pydes", "symmetric-cipher", ["DES", "3DES"], "Critical", CLASSICAL, None, None,
     "pyDes implements pure-Python DES/3DES with 56/112-bit keys. Migrate to AES-256-GCM via "
     "cryptography."),
    ("pip", "pycrypto", "library-deprecated", ["Legacy Crypto", "DES", "ARC4", "MD5", "RSA"],
     "Critical", CLASSICAL, None, None,
     "pycrypto is unmaintained since 2013 with known unpatched CVEs (e.g. CVE-2013-7459) — "
     "migrate to pycryptodome."),
    ("pip", "pycryptodome", "general-crypto",
     ["General Crypto", "AES", "DES", "3DES", "RSA", "ECC", "SHA-256", "MD5", "RC4", "Blowfish"],
     "Informational", SAFE, "Maintained fork of pycrypto — cataloged for CBOM completeness.",
     None,
     "No action needed; ensure strong algorithms (AES-GCM, SHA-256) are selected in code."),
    ("pip", "cryptography", "general-crypto",
     ["General Crypto", "AES", "ChaCha20", "RSA", "ECDSA", "Ed25519"], "Informational", SAFE,
     "Standard Python cryptography library — cataloged for CBOM completeness.", None,
     "No action needed; prefer hazmat AEAD ciphers and modern KEM/DSA when available."),
    ("pip", "rsa", "asymmetric", ["RSA"], "Medium", BROKEN, None, None,
     "Plan migration to ML-KEM/ML-DSA (FIPS 203/204)."),
    ("pip", "arc4", "stream-cipher", ["RC4"], "Critical", CLASSICAL, None, None,
     "arc4 implements broken RC4 stream cipher. Migrate to AES-256-GCM."),
    ("pip", "blowfish", "symmetric-cipher", ["Blowfish"], "High", CLASSICAL, None, None,
     "Blowfish is a 64-bit block cipher vulnerable to Sweet32. Migrate to AES-256-GCM."),
    ("pip", "pyjwt", "signature", ["JWT"], "Low", CLASSICAL, "Verify 'alg' is never 'none'.",
     "2.4.0", "Ensure PyJWT is >= 2.4.0 and algorithms are explicitly whitelisted."),
    ("pip", "paramiko", "library", ["SSH/Crypto"], "Low", CLASSICAL,
     "SSH library — check pinned version against known CVEs manually.", None,
     "Keep paramiko updated to avoid known transport vulnerabilities."),
    ("maven", "bouncycastle", "general-crypto", ["BouncyCastle"], "Informational", CLASSICAL,
     "General crypto provider — audit which algorithms are configured.", None,
     "Audit configured BouncyCastle providers and ensure PQC/hybrid algorithms are utilized."),
    ("maven", "bcprov-jdk15on", "general-crypto", ["BouncyCastle"], "Informational", CLASSICAL,
     "BouncyCastle Provider — audit which algorithms are configured.", None,
     "Audit configured BouncyCastle providers."),
    ("maven", "bcprov-jdk18on", "general-crypto", ["BouncyCastle"], "Informational", SAFE,
     "Modern BouncyCastle Provider with PQC support.", None,
     "Leverage ML-KEM and ML-DSA modules available in bcprov-jdk18on."),
]
UNSPECIFIC_LIBRARY_ALGORITHMS = [
    "GENERAL CRYPTO", "LEGACY CRYPTO", "SSH/CRYPTO", "BOUNCYCASTLE",
]
LABEL_NOISE_WORDS = ["MODE", "KEY", "WEAK", "STATIC", "RAW"]

# --- Fixed values: purposes ---------------------------------------------------
PURPOSE_KEYWORDS = {
    "key_exchange": ["handshake", "key_exchange", "keyexchange", "ecdh", "dh_exchange",
                     "session_key", "shared_secret"],
    "digital_signature": ["sign", "signature", "verify_signature", "jwt", "certificate",
                          "sign_token", "cert_"],
    "data_encryption": ["encrypt", "decrypt", "cipher", "aes_encrypt", "payload_encrypt",
                        "file_encrypt"],
    "password_hashing": ["password", "passwd", "credential_hash", "pbkdf", "bcrypt", "scrypt",
                         "argon2"],
    "mac": ["hmac", "mac_verify", "integrity_check", "message_auth"],
    "random_generation": ["random", "nonce", "iv_gen", "salt_gen", "token_gen", "csprng"],
}
USAGE_TO_PURPOSE = {
    "key_exchange": "key_exchange",
    "signature": "digital_signature",
    "encryption": "data_encryption",
    "decryption": "data_encryption",
    "password_hashing": "password_hashing",
    "mac": "mac",
    "random": "random_generation",
    "token_key_generation": "random_generation",
    "hash": "integrity_hashing",
    "hashing": "integrity_hashing",
}
USAGE_CRITICALITY = {
    "key_exchange": 90, "digital_signature": 90, "password_hashing": 85, "data_encryption": 80,
    "mac": 60, "random_generation": 70, "integrity_hashing": 55, "unknown": 50,
}
PURPOSE_LIFETIME_YEARS = {
    "data_encryption": 20, "password_hashing": 15, "key_exchange": 10, "digital_signature": 5,
    "mac": 5, "random_generation": 5, "integrity_hashing": 3, "unknown": 10,
}

# --- Fixed values: scoring ----------------------------------------------------
WEIGHTS_CURRENT = {"quantum": 0.40, "key": 0.20, "deprecation": 0.15, "usage": 0.10,
                   "exposure": 0.15}
WEIGHTS_CLASSIC = {"quantum": 0.4, "key": 0.3, "deprecation": 0.2, "usage": 0.1}
MULTIPLIERS_CURRENT = {"Critical": 1.25, "Important": 1.10, "Standard": 1.0}
MULTIPLIERS_CLASSIC = {"Critical": 1.25, "High": 1.15, "Medium": 1.0, "Low": 0.9}
DEPRECATION = {"MD5": 100, "SHA1": 90, "SHA-1": 90, "DES": 100, "3DES": 80, "RC4": 100,
               "RC2": 90, "ECB": 70}
THREAT_HORIZON_YEARS = 7
MIGRATION_YEARS = 3
DEFAULT_LIFETIME_YEARS = 10
SHOR_FAMILIES = ["RSA", "ECC", "ECDSA", "ECDH", "DSA", "DH", "EDDSA"]
STRONG_HASHES = ["SHA-256", "SHA256", "SHA-384", "SHA-512", "SHA3-256", "SHA3-512"]

# --- Fixed values: migration guidance (family, purpose, advice, standard, rationale)
GUIDANCE = [
    ("RSA", "key_exchange", "ML-KEM (Kyber)", "FIPS 203",
     "RSA key transport is broken by Shor’s algorithm; ML-KEM is the NIST-selected KEM "
     "replacement."),
    ("RSA", "digital_signature", "ML-DSA (Dilithium)", "FIPS 204",
     "RSA signatures are broken by Shor’s algorithm; ML-DSA is the primary NIST PQC signature "
     "standard. Use SLH-DSA where a conservative hash-based fallback is preferred."),
    ("RSA", "unknown", "ML-KEM or ML-DSA (confirm usage first)", "FIPS 203 / FIPS 204",
     "RSA usage purpose could not be determined from available context; classify as key-exchange "
     "or signature before migrating."),
    ("ECC", "key_exchange", "ML-KEM (Kyber)", "FIPS 203",
     "ECDH is broken by Shor’s algorithm; ML-KEM replaces it for key establishment."),
    ("ECC", "digital_signature", "ML-DSA (Dilithium)", "FIPS 204",
     "ECDSA/EdDSA signatures are broken by Shor’s algorithm."),
    ("ECC", "unknown", "ML-KEM or ML-DSA (confirm usage first)", "FIPS 203 / FIPS 204",
     "ECC curve usage purpose unclear from context."),
    ("DH", "key_exchange", "ML-KEM (Kyber)", "FIPS 203",
     "Finite-field Diffie-Hellman is broken by Shor’s algorithm."),
    ("DSA", "digital_signature", "ML-DSA (Dilithium)", "FIPS 204",
     "DSA signatures are broken by Shor’s algorithm."),
    ("AES", "data_encryption", "Keep AES-256 (increase key size if <256-bit)",
     "NIST SP 800-38 series",
     "Symmetric ciphers are only weakened (not broken) by Grover’s algorithm, which halves "
     "effective key strength. AES-256 retains ~128-bit post-quantum security; AES-128 does not."),
    ("AES", "unknown", "Confirm mode/key size; prefer AES-256-GCM", "NIST SP 800-38D",
     "AES purpose unclear from context; default guidance is AES-256 in an authenticated mode."),
    ("ChaCha20", "data_encryption", "Keep ChaCha20-Poly1305 (256-bit key already)", "RFC 8439",
     "Already at 256-bit key strength; adequate post-quantum symmetric margin under Grover’s "
     "algorithm."),
    ("DES", "data_encryption", "Replace with AES-256-GCM", "NIST SP 800-38D",
     "DES/3DES are cryptographically broken independent of quantum concerns (small block/key "
     "size, known practical attacks)."),
    ("MD5", "integrity_hashing", "Replace with SHA-256 or SHA-3-256", "FIPS 180-4 / FIPS 202",
     "MD5 is broken classically (collision attacks); not a quantum-migration issue, it is already "
     "unsafe today."),
    ("SHA1", "integrity_hashing", "Replace with SHA-256 or SHA-3-256", "FIPS 180-4 / FIPS 202",
     "SHA-1 has practical collision attacks; deprecated by NIST since 2011, disallowed since 2030 "
     "(already unsafe today)."),
    ("SHA-256", "integrity_hashing", "No change needed", "FIPS 180-4",
     "Grover’s algorithm only reduces preimage resistance from 256 to ~128 bits, which remains "
     "adequate."),
    ("SHA-256", "mac", "No change needed (HMAC-SHA256)", "FIPS 198-1",
     "Hash-based MACs retain adequate post-quantum margin at 256-bit output."),
]
MANUAL_REVIEW = "Manual review required"
HYBRID_FAMILIES = ["RSA", "ECC", "DH", "DSA"]
AGILITY_BASE = {"ECC": 40, "RSA": 30, "DH": 30, "DSA": 25, "AES": 45, "ChaCha20": 45,
                "SHA-256": 45, "DES": 10, "MD5": 10, "SHA1": 15}
AGILITY_PURPOSE = {"key_exchange": 30, "data_encryption": 30, "mac": 25, "integrity_hashing": 25,
                   "digital_signature": 25, "password_hashing": 20, "random_generation": 20}
POST_QUANTUM_PRIMITIVES = [
    "ML-KEM", "MLKEM", "KYBER", "ML-DSA", "MLDSA", "DILITHIUM", "SLH-DSA", "SLHDSA", "SPHINCS",
    "FALCON", "BIKE", "HQC", "NTRU", "FRODO", "XMSS", "LMS", "CRYSTALS-KYBER",
    "CRYSTALS-DILITHIUM",
]
RESISTANT_MIN_BITS = {"AES": 192, "CHACHA20": 0, "SHA-256": 0, "SHA-384": 0, "SHA-512": 0,
                      "SHA3-256": 0, "SHA3-512": 0, "HMAC": 0}
CLASSICALLY_BROKEN = ["MD5", "SHA1", "SHA-1", "DES", "3DES", "RC4", "RC2"]
# recommendation prefix -> primitive, key size, mode after migration; first prefix wins
AFTER_MIGRATION = [
    ("ML-KEM", "ML-KEM", 768, None),
    ("ML-DSA", "ML-DSA", 1312, None),
    ("SLH-DSA", "SLH-DSA", None, None),
    ("AES-256", "AES", 256, "GCM"),
    ("SHA-256", "SHA-256", None, None),
    ("Keep AES-256", "AES", 256, "GCM"),
    ("Keep ChaCha20", "ChaCha20", 256, "Poly1305"),
]

# --- Fixed values: access roles and provenance defaults -----------------------
ELEVATED_ROLES = ["Admin", "Security Team", "Auditor"]
DEFAULT_SCANNER_VERSION = "2.4.0"
DEFAULT_ORG = "default-org"
DEFAULT_BATCH_SCANNER_VERSION = "1.0.0"
