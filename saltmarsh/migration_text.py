"""Migration step lists by purpose and primitive family."""

# --- Fixed values: steps shown for one component ------------------------------
# (purpose, family) -> steps; DEFAULT applies when the family has no list of its own
COMPONENT_STEPS = {
    ("key_exchange", "RSA"): [
        "Audit all RSA key-transport usages in scope (TLS, PKCS#7, CMS, etc.)",
        "Inventory all consumers that must validate the key exchange",
        "Select ML-KEM-768 (NIST FIPS 203) as the PQC KEM replacement",
        "Deploy hybrid mode: X25519/RSA alongside ML-KEM-768 during transition",
        "Update server-side TLS configuration to advertise hybrid KEM groups",
        "Verify client library support for hybrid KEM in all target environments",
        "Migrate to ML-KEM-768 exclusively after all consumers are updated",
        "Remove classical RSA key-exchange cipher suites from supported list",
        "Validate with PQC compliance test suite",
    ],
    ("key_exchange", "ECC"): [
        "Audit all ECDH usages (TLS handshake, ECIES, SSH ECDH, etc.)",
        "Inventory all consumers relying on this key agreement",
        "Select ML-KEM-768 (NIST FIPS 203) as the PQC KEM replacement",
        "Deploy hybrid mode: ECDH alongside ML-KEM-768 during transition",
        "Update TLS/SSH configurations to advertise hybrid KEM groups",
        "Verify PQC library support in all target runtime environments",
        "Transition exclusively to ML-KEM-768 after consumer readiness is confirmed",
        "Remove classical ECDH cipher suites from the supported configuration",
        "Validate with PQC compliance test suite",
    ],
    ("key_exchange", "DH"): [
        "Identify all finite-field DH usages in scope",
        "Select ML-KEM-768 (NIST FIPS 203) as the PQC KEM replacement",
        "Deploy hybrid mode: classic DH alongside ML-KEM during transition",
        "Update library and protocol configurations to negotiate hybrid KEM",
        "Migrate exclusively to ML-KEM after validation",
    ],
    ("key_exchange", "DEFAULT"): [
        "Audit the key-exchange mechanism and identify all dependents",
        "Evaluate ML-KEM (NIST FIPS 203) as the PQC replacement KEM",
        "Plan and execute a hybrid classical + PQC transition",
        "Validate before removing the classical mechanism",
    ],
    ("digital_signature", "RSA"): [
        "Audit all RSA signature usages (JWT, TLS certificates, code signing, etc.)",
        "Inventory all verifiers that must accept the new signature scheme",
        "Select ML-DSA-65 (NIST FIPS 204) as the primary PQC signature replacement",
        "Consider SLH-DSA-SHA2-128s as a conservative hash-based alternative",
        "Deploy dual-signing: sign with both RSA and ML-DSA during transition",
        "Update certificate authority to issue dual-algorithm certificates",
        "Update verifier code to accept either classical or PQC signatures",
        "Issue new certificates signed with ML-DSA exclusively after full roll-out",
        "Revoke legacy RSA-only certificates on completion",
        "Validate with a PQC compliance test suite and certificate transparency log",
    ],
    ("digital_signature", "ECC"): [
        "Audit all ECDSA/EdDSA signature usages in scope",
        "Inventory all verifiers",
        "Select ML-DSA-65 (NIST FIPS 204) as the PQC signature replacement",
        "Deploy dual-signing: ECDSA alongside ML-DSA during transition",
        "Update verifiers to accept ML-DSA signatures",
        "Transition exclusively to ML-DSA after verifier readiness is confirmed",
        "Remove ECDSA from signing path on completion",
        "Validate with a PQC compliance test suite",
    ],
    ("digital_signature", "DSA"): [
        "DSA is already deprecated — replace with ML-DSA (NIST FIPS 204) directly",
        "Audit all DSA signature usages and affected verifiers",
        "Deploy ML-DSA-65 in parallel with legacy DSA during transition",
        "Update verifiers to accept ML-DSA exclusively and remove DSA support",
    ],
    ("digital_signature", "DEFAULT"): [
        "Audit the signature scheme and identify all signers and verifiers",
        "Evaluate ML-DSA (NIST FIPS 204) as the primary PQC replacement",
        "Consider SLH-DSA (NIST FIPS 205) for conservative hash-based fallback",
        "Deploy dual-signing during transition and migrate verifiers first",
        "Remove the classical signature scheme after full validation",
    ],
}
STEPS_SYMMETRIC = [
    "Verify current key size meets the post-quantum minimum (AES-256 / ChaCha20-256)",
    "If key size is below 192-bit, upgrade to AES-256-GCM immediately",
    "Ensure an authenticated encryption mode (GCM, CCM) is used — not ECB/CBC",
    "Rotate encryption keys as part of normal key-management lifecycle",
    "No structural PQC algorithm migration required for AES-256 or ChaCha20-256",
]
STEPS_BROKEN_CIPHER = [
    "DES/3DES is cryptographically broken — replace immediately",
    "Migrate to AES-256-GCM (NIST SP 800-38D) as the replacement cipher",
    "Audit all data encrypted under the broken cipher — re-encrypt with AES-256",
    "Remove the broken cipher from all supported configurations",
    "This is an URGENT classical security issue, not just a quantum migration",
]
STEPS_PASSWORD = [
    "MD5/SHA-1 password hashes are broken classically — replace immediately",
    "Migrate to Argon2id (RFC 9106) as the preferred password hashing function",
    "Alternatively use bcrypt (cost ≥ 12) or scrypt (N ≥ 2^17) as a fallback",
    "Force password reset for all affected users after hash migration",
    "This is an URGENT classical security issue independent of quantum risk",
]
STEPS_BROKEN_HASH = [
    "MD5/SHA-1 are broken for collision resistance — replace immediately",
    "Migrate to SHA-256 or SHA3-256 (FIPS 180-4 / FIPS 202)",
    "Re-hash all stored integrity digests using the new function",
]
STEPS_ADEQUATE_HASH = [
    "SHA-256 retains ~128-bit post-quantum preimage security under Grover's algorithm",
    "No structural algorithm migration needed; continue to use SHA-256 or upgrade to SHA-512",
    "Consider SHA3-256 for new implementations to improve agility",
]
STEPS_POST_QUANTUM = ["No migration required — this is already a post-quantum algorithm."]
STEPS_REVIEW = ["Review migration path with a cryptography specialist."]
STEPS_GENERIC = [
    "Identify the precise usage of this cryptographic primitive",
    "Consult NIST PQC standards (FIPS 203, 204, 205) for the appropriate PQC replacement",
    "Plan a hybrid classical + PQC transition strategy",
    "Validate the migration with a PQC compliance test suite",
]

# --- Fixed values: steps used inside a whole-scan plan, where they differ -----
PLAN_STEPS = {
    ("key_exchange", "RSA"): COMPONENT_STEPS[("key_exchange", "RSA")],
    ("key_exchange", "ECC"): COMPONENT_STEPS[("key_exchange", "ECC")],
    ("key_exchange", "DH"): COMPONENT_STEPS[("key_exchange", "DH")],
    ("key_exchange", "DEFAULT"): [
        "Audit the key-exchange mechanism and identify all dependents",
        "Evaluate ML-KEM (NIST FIPS 203) as the PQC replacement KEM",
        "Deploy a hybrid scheme combining the classical algorithm with ML-KEM",
        "Transition exclusively to ML-KEM after successful hybrid validation",
    ],
    ("digital_signature", "RSA"): [
        "Audit all RSA signature usages (JWT, X.509, CMS, documents)",
        "Assess impact of increased signature sizes on the protocol/storage",
        "Select ML-DSA (NIST FIPS 204) as the primary replacement",
        "For firmware/bootloaders, consider SLH-DSA (FIPS 205) or LMS/XMSS",
        "Deploy hybrid signatures during the transition period",
        "Migrate roots of trust and intermediate CAs to PQC",
        "Transition exclusively to ML-DSA/SLH-DSA after all verifiers are updated",
    ],
    ("digital_signature", "ECC"): [
        "Audit all ECDSA/EdDSA signature usages",
        "Evaluate ML-DSA (NIST FIPS 204) as the PQC replacement",
        "Assess impact of increased signature sizes on network packets/storage",
        "Deploy hybrid signatures (ECDSA + ML-DSA) during transition",
        "Transition exclusively to ML-DSA once ecosystem supports it",
    ],
    ("digital_signature", "DEFAULT"): [
        "Audit signature mechanism usages",
        "Evaluate ML-DSA (NIST FIPS 204) or SLH-DSA (NIST FIPS 205)",
        "Implement hybrid signing during the transition",
        "Transition exclusively to PQC after ecosystem validation",
    ],
}
PLAN_STEPS_DEFAULT = [
    "Audit primitive usages and determine specific application constraints",
    "Consult NIST PQC standards (FIPS 203, 204, 205) for replacements",
    "Plan a hybrid deployment approach",
    "Validate with test vectors before full migration",
]
