"""Configuration and infrastructure detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltmarsh import fixed_values as fv
from saltmarsh.functions import predicates as p
from saltmarsh.functions.text import file_kind, is_code, key_value, to_lines
from saltmarsh.schemas import explode_findings, finding, some

TLS_ADVICE = {
    "docker": "Remove TLS-disabling flags (curl -k, wget --no-check-certificate, "
              "NODE_TLS_REJECT_UNAUTHORIZED=0).",
    "yaml": "Remove TLS-disabling settings and configure trusted CA certs.",
}
TAGS = {
    "docker": (("dockerfile", "tls", "mitm-risk"), ("dockerfile", "weak-algorithm"),
               ("dockerfile", "hardcoded-secret")),
    "env": ((), ("env-file", "weak-algorithm"), ("env-file", "committed-secret")),
    "yaml": (("config", "tls", "mitm-risk"), ("config", "weak-algorithm"),
             ("config", "plaintext-secret")),
    "ini": ((), ("config", "weak-algorithm"), ("config", "ini", "plaintext-secret")),
}


def _quoted(*parts) -> Column:
    return F.concat(*[part if isinstance(part, Column) else F.lit(part) for part in parts])


def _by_kind(values: dict[str, Column]) -> Column:
    chain = None
    for fmt, value in values.items():
        own = F.col("kind") == fmt
        chain = F.when(own, value) if chain is None else chain.when(own, value)
    return chain


def _texts(values: dict[str, str]) -> Column:
    return _by_kind({fmt: F.lit(v) for fmt, v in values.items()})


def _tag_sets(place: int) -> Column:
    return _by_kind({fmt: F.array(*[F.lit(x) for x in tags[place]]).cast("array<string>")
                     for fmt, tags in TAGS.items()})


def _messages() -> tuple[Column, Column]:
    word, key, value = F.col("kv.word"), F.col("kv.key"), F.col("kv.value")
    weak = _by_kind({
        "docker": _quoted("Dockerfile ", word, " sets '", key, "' to weak algorithm '", value, "'."),
        "env": _quoted("Environment variable '", key, "' configures weak algorithm '", value, "'."),
        "yaml": _quoted("Config key '", key, "' sets weak/deprecated algorithm '", value, "'."),
        "ini": _quoted("Configuration '", key, "' specifies weak algorithm '", value, "'."),
    })
    secret = _by_kind({
        "docker": _quoted("Dockerfile ", word, " sets '", key, "' to a plaintext literal secret."),
        "env": _quoted("Variable '", key, "' in committed .env file holds a plaintext secret."),
        "yaml": _quoted("Config key '", key, "' holds a plaintext literal secret."),
        "ini": _quoted("Configuration '", key, "' in ", p.basename(F.col("path")),
                       " holds plaintext secret."),
    })
    return weak, secret


def detect_config(files: DataFrame) -> DataFrame:
    """Disabled TLS checks, weak algorithms and secrets, by the format of the file.

    Each line is taken apart once; the key, the algorithm profile and the secret test are
    columns of their own, whatever the format.
    """
    kind, raw, line = F.col("kind"), F.col("raw"), F.col("line")
    lines = to_lines(
        files.withColumn("kind", file_kind(F.col("path"))).filter(kind.isNotNull()))
    none = F.array().cast("array<string>")
    lines = lines.withColumns({
        "kv": _by_kind({fmt: key_value(raw, fmt) for fmt in TAGS}),
        "off": F.when(
            kind.isin(list(TLS_ADVICE)) & _by_kind({f: is_code(raw, f) for f in TAGS}),
            p.tls_disabled_labels(raw)).otherwise(none),
    }).filter(F.col("kv").isNotNull() | (F.size("off") > 0))
    key, value = F.col("kv.key"), F.col("kv.value")
    opened = (kind == "yaml") & (value.startswith("{") | value.startswith("["))
    lines = lines.withColumns({
        "weak": p.classify_algorithm(value),
        "secret": p.is_secret_name(key) & ~p.is_placeholder(value, "config")
        & ~p.is_known_algorithm(value) & (F.length(value) >= 4) & ~opened,
        "snippet": p.strip(raw),
    })
    weak, snippet = F.col("weak"), F.col("snippet")
    weak_message, secret_message = _messages()
    setting = F.when(weak.isNotNull(), finding(
        line, "config", "config-weak-algorithm", weak["rule_name"], weak["category"],
        weak["algorithm"], weak["severity"], fv.CLASSICAL, weak["recommendation"], snippet,
        weak_message, confidence="Possible", tags=_tag_sets(1),
    )).when(F.col("secret"), finding(
        line, "config",
        F.when(kind == "docker", "dockerfile-hardcoded-secret").otherwise("config-plaintext-secret"),
        F.when(kind == "docker", "Dockerfile hardcoded secret")
        .when(kind == "env", "Plaintext secret in .env file")
        .otherwise("Plaintext secret in config file"),
        "hardcoded-secret", "Hardcoded key material", "High", fv.CLASSICAL,
        F.when(kind == "env", "Remove .env from version control, use a secrets manager, and "
               "rotate credentials.").otherwise(fv.HARDCODED_KEY[3]),
        snippet, secret_message, confidence="Possible", tags=_tag_sets(2),
    ))
    start = _texts({
        "docker": "TLS/SSL certificate verification is explicitly disabled (",
        "yaml": "TLS certificate verification disabled in config (",
    })
    off = F.transform("off", lambda label: finding(
        line, "config", "tls-verification-disabled", "TLS verification disabled", "tls",
        "Disabled TLS verification", "Critical", fv.CLASSICAL, _texts(TLS_ADVICE), snippet,
        _quoted(start, label, ")."), confidence="Possible", tags=_tag_sets(0),
    ))
    return explode_findings(lines, F.concat(off, some(setting)), "config")


# --- infrastructure -----------------------------------------------------------
def is_web_server(path: Column) -> Column:
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    hint = F.lit(False)
    for word in fv.WEB_SERVER_PATH_HINTS:
        hint = hint | low.contains(word)
    named = p.basename(low).isin(fv.WEB_SERVER_FILES)
    return named | ((low.endswith(".conf") | low.endswith(".cfg")) & hint)


def detect_web_server(files: DataFrame) -> DataFrame:
    lines = to_lines(files.filter(is_web_server(F.col("path"))))
    lines = lines.filter(is_code(F.col("raw"), "web")).withColumn("code", p.strip(F.col("raw")))
    line, code = F.col("line"), F.col("code")

    def hit(patterns, weak, rule_id, name, label, advice, tags, start):
        tokens = p.weak_tokens(p.directive(code, patterns), weak)
        return F.when(
            F.size(tokens) > 0,
            finding(
                line, "infra", rule_id, name, "tls", label, "High", fv.CLASSICAL, advice, code,
                _quoted(start, F.array_join(tokens, ", "), "."), specificity=3, tags=tags,
            ),
        )

    return explode_findings(lines, some(
        hit(fv.PROTOCOL_DIRECTIVES, fv.WEAK_PROTOCOL, "infra-weak-tls-protocol",
            "Weak TLS Protocol in Web Server Config", "TLS/SSL",
            "Disable legacy SSLv2, SSLv3, TLSv1, and TLSv1.1 protocols. Enforce TLSv1.2 or "
            "TLSv1.3 only.", ("infra", "tls", "web-server"),
            "Deprecated TLS protocol(s) enabled: "),
        hit(fv.CIPHER_DIRECTIVES, fv.WEAK_CIPHER, "infra-weak-cipher-suite",
            "Weak Cipher Suite in Web Server Config", "Cipher Suite",
            "Remove broken ciphers (RC4, DES, 3DES, MD5, NULL, EXPORT). Use modern AEAD suites "
            "(ECDHE-ECDSA-AES256-GCM-SHA384, etc.).", ("infra", "tls", "ciphers"),
            "Insecure cipher(s) configured: "),
    ), "infra")


def detect_terraform(files: DataFrame) -> DataFrame:
    lines = to_lines(files.filter(F.lower("path").endswith(".tf")))
    raw = F.col("raw")
    lines = lines.filter(is_code(raw, "terraform") & raw.rlike(fv.TERRAFORM_LITERAL))
    name = F.regexp_extract(raw, fv.TERRAFORM_LITERAL, 1)
    value = p.strip(F.regexp_extract(raw, fv.TERRAFORM_LITERAL, 2))
    found = F.when(
        p.is_terraform_literal(value) & p.is_secret_name(name),
        finding(
            F.col("line"), "infra", "infra-terraform-hardcoded-secret",
            "Hardcoded Secret in Terraform", "hardcoded-secret", "Plaintext Secret", "High",
            fv.CLASSICAL,
            "Do not hardcode secrets in Terraform manifests. Use input variables or a secret "
            "manager integration (AWS Secrets Manager, HashiCorp Vault).", p.strip(raw),
            _quoted("Terraform attribute '", name, "' assigned literal secret value."),
            specificity=2, confidence="Possible", tags=("infra", "terraform", "hardcoded-secret"),
        ),
    )
    return explode_findings(lines, some(found), "infra")


def cluster_secret_entries(files: DataFrame) -> DataFrame:
    """key/value lines inside the data sections of Secret documents.

    Only files that declare a Secret somewhere are split into lines and shuffled; a window
    then covers one such file, which was one row to begin with.
    """
    text = F.col("text")
    yaml = files.filter(
        (file_kind(F.col("path")) == "yaml")
        & F.lower("path").rlike(r"\.ya?ml$")
        & text.rlike(r"(?im)^\s*kind\s*:\s*Secret\b")
    )
    lines = to_lines(yaml).withColumn("code", p.strip(F.col("raw")))
    code = F.col("code")
    lines = lines.filter((code != "") & ~code.startswith("#"))
    so_far = Window.partitionBy("scan_id", "path").orderBy("line").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    separator = code == "---"
    kind_secret = code.rlike(r"(?i)^kind\s*:\s*Secret\b")
    kind_other = code.rlike(r"(?i)^kind\s*:\s*[A-Za-z0-9]+") & ~kind_secret
    lines = lines.withColumn(
        "in_secret",
        F.coalesce(F.last(
            F.when(separator | kind_other, False).when(kind_secret, True), ignorenulls=True
        ).over(so_far), F.lit(False)),
    )
    header = code.rlike(r"^(?:stringData|data)\s*:\s*$")
    closes = (
        ~F.col("raw").rlike(r"^\s") & code.contains(":")
        & ~code.startswith("stringData") & ~code.startswith("data")
    )
    section = (
        F.when(separator | kind_other, "")
        .when(~F.col("in_secret") | kind_secret, None)
        .when(header, F.regexp_extract(code, r"^(\w+)", 1))
        .when(closes, "")
    )
    lines = lines.withColumn("section", F.last(section, ignorenulls=True).over(so_far))
    return (
        lines.filter(
            F.col("in_secret") & F.col("section").isin("data", "stringData")
            & ~header & ~kind_secret & code.contains(":")
        )
        .withColumn("key", p.strip(F.substring_index(code, ":", 1)))
        .withColumn("value", p.strip_chars(p.strip(F.regexp_replace(code, r"^[^:]*:", "")), "\"'"))
        .drop("in_secret", "raw")
    )


def detect_cluster_secrets(files: DataFrame) -> DataFrame:
    value = F.col("value")
    entries = cluster_secret_entries(files).filter(
        (F.length(value) >= 4) & ~value.startswith("<") & ~value.startswith("${")
        & ((F.col("section") == "stringData") | p.is_base64_secret(value))
    )
    found = finding(
        F.col("line"), "infra", "infra-k8s-secret-plaintext",
        "Plaintext or Reversible Secret in Kubernetes Manifest", "hardcoded-secret",
        "Plaintext Secret", "High", fv.CLASSICAL,
        "Kubernetes Secret data/stringData fields committed to version control expose plaintext "
        "secrets. Use external secret operators (External Secrets Operator, SealedSecrets, or "
        "Vault).", F.col("code"),
        _quoted("Kubernetes Secret entry '", F.col("key"),
                "' contains literal/base64 committed secret."),
        specificity=2, confidence="Possible", tags=("infra", "kubernetes", "hardcoded-secret"),
    )
    return explode_findings(entries, F.array(found), "infra")


def detect_infra(files: DataFrame) -> DataFrame:
    return (
        detect_web_server(files)
        .unionByName(detect_terraform(files))
        .unionByName(detect_cluster_secrets(files.filter(~is_web_server(F.col("path")))))
    )
