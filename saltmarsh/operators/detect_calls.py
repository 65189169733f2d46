"""Call-site and comparison detectors for Python and JavaScript.

``code_rows`` cuts files into flat rows, written once. Import aliases (J01), constants (X17, J02) and enclosing functions (X18) are looked
up among those rows by the file and a name or a place. The rows of a file are dealt to one task, once, and sorted there as often as
something is looked up; a task spills what it cannot hold. Everything a rule says about a site is columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh import fixed_values as fv
from saltmarsh.functions import code_rows as cr
from saltmarsh.functions import predicates as p
from saltmarsh.functions import text as tx
from saltmarsh.operators.intervals import innermost
from saltmarsh.operators.resolve import follow, last_bindings, look_up, through_imports
from saltmarsh.operators.skew import merge_join
from saltmarsh.schemas import LAYER_ORDER, finding
from saltmarsh.session import stored

#: Stands as the callee of an equality test.
EQUALITY = "=="

# A file whose text has none of these words cannot hold a site: an alias is introduced by the word it stands for.
PYTHON_MAYBE = (
    r"(?i)md5|sha1|sha256|sha3_256|sha512|hashlib|AES|DES|RC2|RC4|Blowfish|"
    r"Crypto|Cipher|Fernet|hmac|newkeys|generate|random|==|!="
)
JS_MAYBE = (
    r"createHash|ipheriv|generateKeyPair|createSign|createVerify|CryptoJS|algo|KJUR|"
    r"Signature|jsrsasign|random|==|!="
)
# A call is looked at when its name, as written, could resolve to a detected one.
JS_CALLEE = (
    r"^crypto\.create(?:Hash|Cipheriv|Decipheriv)$|^crypto\.generateKeyPair(?:Sync)?$|"
    r"^(?:crypto\.)?create(?:Sign|Verify)$|CryptoJS|^algo\.|KJUR|Signature|jsrsasign|"
    r"^Math\.random$"
)


KEYS = ["scan_id", "repo_id", "path"]
#: The arguments that rules look at, by the role they play.
ROLES = ("arg0", "arg1", "mode", "iv", "size", "digest", "inner", "left", "right")


def code_rows(files: DataFrame, language: str, callees: str | None = None, comparisons: bool = False) -> DataFrame:
    """The flat rows of every file, one by one, with a number for the file and one for the row within it.

    Several steps read them, so they are written to the shared folder; the texts are read once. Rows of kind ``error`` tell which
    files could not be read as their language, and why.
    """
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    rows = cr.rows_in(F.col("text"), language, callees, comparisons)
    numbered = files.select(*KEYS, F.monotonically_increasing_id().alias("file"), rows.alias("rows"))
    return stored(numbered.select(*KEYS, "file", F.posexplode("rows").alias("seq", "r")).select(*KEYS, "file", "seq", "r.*"))


def unread_files(rows: DataFrame) -> DataFrame:
    """Files that gave no rows because they could not be read as their language: ``reason`` and ``line``."""
    return rows.where(F.col("kind") == cr.ERROR).select(*KEYS, F.col("target").alias("reason"), "line")


def imports(rows: DataFrame, of: Sequence[str] = ("file",)) -> DataFrame:
    """``file, local, target``: what the last import of each name gave (X16). ``of`` may add columns that follow from the file."""
    found = rows.where(F.col("kind") == cr.ALIAS)
    return found.groupBy(*of, F.col("name").alias("local")).agg(F.max_by("target", "place").alias("target"))


def constants(rows: DataFrame, of: Sequence[str] = ("file",)) -> DataFrame:
    """``file, name, value``: the last value of each name (X17); ``of`` as for ``imports``. In JavaScript an assignment counts over a declaration, as it comes later."""
    found = rows.where(F.col("kind").isin(cr.BIND, cr.REBIND))
    order = F.struct(F.col("kind") == cr.REBIND, F.col("place"))
    return last_bindings(found, list(of), order, F.col("args")[0]["value"])


def _named(keyword: str):
    return lambda argument: argument["keyword"] == keyword


def _roles(language: str) -> Column:
    """(role, value) of the arguments of a call or the sides of a comparison."""
    args, by_place = F.col("args"), F.filter("args", lambda a: a["keyword"].isNull())

    def given(place: int | None, *names: str) -> Column:
        word = [F.get(F.filter(args, _named(n)), F.lit(0))["value"] for n in names]
        return F.coalesce(*word, *([F.get(by_place, F.lit(place))["value"]] if place is not None else []))

    python = language == "python"
    call = {
        "arg0": given(0), "arg1": given(1), "mode": given(1, "mode"), "iv": given(2, "iv", "nonce") if python else given(2),
        "size": given(None, "key_size"), "digest": given(2, "digestmod") if python else given(2),
        "inner": F.get(by_place, F.lit(0))["inner"],
    }
    sides = {"left": F.get(args, F.lit(0))["value"], "right": F.get(args, F.lit(1))["value"]}

    def listed(values: dict[str, Column]) -> Column:
        pairs = F.array(*[F.struct(F.lit(r).alias("role"), v.alias("value")) for r, v in values.items()])
        return F.filter(pairs, lambda x: x["value"].isNotNull())

    return F.when(F.col("kind") == cr.CALL, listed(call)).otherwise(listed(sides))


def call_sites(
    files: DataFrame, language: str, callees: str | None = None, comparisons: bool = False
) -> DataFrame:
    """One row per call with its resolved name and arguments.

    ``callees`` keeps the calls whose resolved name matches. With ``comparisons`` equality tests come along as
    rows named ``==``, so one pass over the texts serves both.
    """
    return sites_of(code_rows(files, language, callees, comparisons), language, callees)


def sites_of(rows: DataFrame, language: str, callees: str | None = None) -> DataFrame:
    """The call sites among the rows of files: names through imports, arguments through bindings, functions around places."""
    one = ["file", "seq"]
    rows = rows.repartition("file")  # the rows of a file lie together from here on, and nothing below deals them anew
    sites = rows.where(F.col("kind").isin(cr.CALL, cr.COMPARE)).select(
        *one, "kind", "place", "line", "target", F.coalesce("name", F.lit(EQUALITY)).alias("callee"), _roles(language).alias("roles"))
    spans = rows.where(F.col("kind") == cr.FUNCTION).select("file", F.col("place").alias("start"), "end", "name")
    sites = innermost(sites, spans, ["file"], id=one, into="function")
    origins = imports(rows)
    if language == "python":
        sites = through_imports(sites, origins, ["file"], "callee")
    if callees is not None:
        sites = sites.where((F.col("kind") == cr.COMPARE) | F.col("callee").rlike(callees))
    lines = rows.where(F.col("kind") == cr.LINE).select("file", "line", "target")
    sites = look_up(sites, F.col("line"), lines, ["file"], "line", "target", "snippet")

    # only arguments that are nothing but a name have something to follow; a mode and both sides of a test stay as written
    asked = F.filter("roles", lambda x: x["value"]["name"].isNotNull() & ~x["role"].isin("mode", "left", "right"))
    own = F.struct(F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("asked"))
    of_role = F.transform(asked, lambda x: F.struct(x["role"].alias("role"), x["value"]["name"].alias("asked")))
    site = F.struct(*[c for c in sites.columns if c not in one])
    # a row for the site and one for each name that it asks for
    parts = sites.select(*one, site.alias("site"), F.explode(F.concat(F.array(own), of_role)).alias("x")).select(
        *one, F.when(F.col("x.role").isNull(), F.col("site")).alias("site"), "x.role", "x.asked")
    parts = look_up(parts, F.col("asked"), follow(constants(rows), ["file"]), ["file"], "name", "value", "led")
    sites = parts.groupBy(*one).agg(
        F.first("site", ignorenulls=True).alias("site"),
        F.collect_list(F.when(F.col("led").isNotNull(), F.struct("role", "led"))).alias("led"),
    ).select(*one, "site.*", F.map_from_entries("led").alias("led"))

    written = F.map_from_entries("roles")
    sites = sites.withColumn("written", written).withColumn(
        "value", F.map_zip_with("written", "led", lambda _, w, v: F.coalesce(v, w)))

    def at(column: str, role: str, field: str) -> Column:
        return F.try_element_at(F.col(column), F.lit(role))[field]

    out = sites.select(
        *one, "line", "callee", F.coalesce("snippet", F.lit("")).alias("snippet"), "function",
        at("written", "arg0", "text").alias("arg0"), at("value", "arg0", "text").alias("arg0_value"), at("value", "arg0", "size").alias("arg0_size"),
        at("written", "arg0", "size").alias("arg0_own_size"),
        at("value", "arg1", "text").alias("arg1_value"), at("value", "arg1", "size").alias("arg1_size"), at("written", "mode", "text").alias("mode_arg"),
        at("value", "iv", "text").alias("iv_value"), at("value", "iv", "size").alias("iv_size"), at("value", "size", "text").alias("size_value"),
        at("value", "digest", "text").alias("digest"), at("value", "inner", "text").alias("inner_value"), at("value", "inner", "size").alias("inner_size"),
        at("written", "left", "text").alias("left"), F.col("target").alias("op"), at("written", "right", "text").alias("right"))
    if language == "python":
        out = through_imports(out, origins, ["file"], "digest")
    # every file that has rows has a first one
    return merge_join(out, rows.where("seq = 0").select("file", *KEYS), ["file"]).select(*KEYS, *[c for c in out.columns if c not in one])


# --- hits ---------------------------------------------------------------------
# What a rule says about a call, before it becomes a finding row. Inputs and profiles are
# columns of their own stage, so each is worked out once per call however many rules read it.
HIT = (
    "struct<rule_id:string,rule_name:string,category:string,label:string,severity:string,"
    "risk:string,advice:string,specificity:int,generic:boolean,tags:array<string>,message:string>"
)
PROFILE_FIELDS = ("label", "severity", "risk", "advice")


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _fixed(profile) -> dict[str, Column]:
    return dict(zip(PROFILE_FIELDS, (F.lit(v) for v in profile)))


def _of(column: str) -> dict[str, Column]:
    return {k: F.col(column)[k] for k in PROFILE_FIELDS}


def hit(
    condition, rule_id, rule_name, category, profile, specificity=1, generic=False, tags=None,
    message=None, **changed,
) -> Column:
    """The rule's statement when the condition holds, else null."""
    said = {**profile, **changed}
    none_tags = F.lit(None).cast("array<string>")
    return F.when(condition, F.struct(
        _lit(rule_id).alias("rule_id"), _lit(rule_name).alias("rule_name"),
        _lit(category).alias("category"), *[said[k].alias(k) for k in PROFILE_FIELDS],
        _lit(specificity).alias("specificity"), _lit(generic).alias("generic"),
        (none_tags if tags is None else tags).alias("tags"),
        F.lit(message).cast("string").alias("message") if message is None else message.alias("message"),
    ))


def explode_hits(rows: DataFrame, hits: list[Column], language: str) -> DataFrame:
    """Findings as rows in emission order."""
    found = F.array_compact(F.array(*[h.cast(HIT) for h in hits]))
    flat = rows.select(
        "scan_id", "repo_id", "path", "line", "snippet", F.posexplode(found).alias("_n", "h"))
    h = F.col("h")
    row = finding(
        F.col("line"), language, h["rule_id"], h["rule_name"], h["category"], h["label"],
        h["severity"], h["risk"], h["advice"], F.col("snippet"),
        F.coalesce(h["message"], F.concat(
            h["rule_name"], F.lit(" at line "), F.col("line").cast("string"), F.lit("."))),
        specificity=h["specificity"], generic=h["generic"],
        tags=F.coalesce(h["tags"], F.array().cast("array<string>")),
    )
    return flat.select("scan_id", "repo_id", "path", "_n", row.alias("f")).select(
        "scan_id", "repo_id", "path", "f.*",
        F.struct(
            F.lit(LAYER_ORDER["code"]).alias("layer"), F.col("f.line").alias("line"),
            F.col("_n").alias("n"), F.col("f.rule_id").alias("rule_id")).alias("emit_seq"))


# --- literals -----------------------------------------------------------------
_PY_LITERAL = r"^[bBrRuU]{0,2}(?:\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\"|'[^'\\]*+(?:\\.[^'\\]*+)*+')$"


def is_literal(value: Column) -> Column:
    return F.coalesce(value.rlike(_PY_LITERAL), F.lit(False))


def literal_text(value: Column) -> Column:
    """Contents of a string literal, null for anything else."""
    return F.when(
        is_literal(value), F.regexp_replace(value, r"^[bBrRuU]{0,2}[\"']|[\"']$", ""))


def literal_int(value: Column) -> Column:
    return F.when(value.rlike(r"^\d+$"), value.try_cast("int"))


def key_bits(value: Column, size: Column) -> Column:
    """Bits of a literal key of a known length, or of a random call with a literal byte count."""
    name = F.regexp_extract(value, r"^([\w.]+)\(", 1)
    drawn = F.when(
        name.isin(fv.PY_RANDOM_BYTE_CALLS),
        F.regexp_extract(value, r"^[\w.]+\(\s*(\d+)\s*[,)]", 1).try_cast("int"))
    return F.nullif(F.coalesce(size, drawn), F.lit(0)) * 8


# --- profiles -----------------------------------------------------------------
def symmetric_profile(algo: Column, mode: Column, bits: Column) -> Column:
    """(label, severity, risk, advice) of a symmetric cipher use."""
    algo, mode = F.upper(algo), F.coalesce(F.upper(mode), F.lit(""))
    sized = F.coalesce(bits, F.lit(0)) != 0
    label = F.when(sized, F.concat_ws("-", algo, bits.cast("string"), mode)).when(
        mode != "", F.concat_ws("-", algo, mode)).otherwise(algo)
    short = F.coalesce(bits, F.lit(256)) < 256
    case = (
        F.when(algo.isin(fv.BROKEN_CIPHERS), "broken").when(mode == "ECB", "ecb")
        .when(mode.isin(fv.AEAD_MODES), F.when(short, "aead-short").otherwise("aead"))
        .when(mode.isin(fv.UNAUTHENTICATED_MODES), "plain").otherwise("other"))
    low = F.when(F.coalesce(bits >= 256, F.lit(False)), "Low").otherwise("Medium")
    return F.struct(
        label.alias("label"),
        F.when(case.isin("broken", "ecb"), "Critical").when(case == "aead-short", "Medium")
        .when(case == "aead", "Informational").otherwise(low).alias("severity"),
        F.when(case.isin("broken", "ecb"), fv.CLASSICAL).when(case == "aead", fv.SAFE)
        .otherwise(fv.WEAKENED).alias("risk"),
        F.when(case == "broken", F.concat(algo, F.lit(fv.REC_BROKEN_CIPHER)))
        .when(case == "ecb", fv.REC_ECB).when(case == "aead-short", fv.REC_AEAD_SHORT)
        .when(case == "aead", fv.REC_AEAD_OK)
        .when(case == "plain", F.concat(mode, F.lit(fv.REC_UNAUTHENTICATED)))
        .otherwise(fv.REC_VERIFY_MODE).alias("advice"),
    )


def rsa_profile(bits: Column) -> Column:
    """(label, severity, risk, advice, tags) of an RSA key."""
    small = F.coalesce(bits < 2048, F.lit(False))
    return F.struct(
        F.when(F.coalesce(bits, F.lit(0)) != 0, F.concat(F.lit("RSA-"), bits.cast("string")))
        .otherwise("RSA").alias("label"),
        F.when(bits < 1024, "Critical").when(small, "High").otherwise("Medium").alias("severity"),
        F.lit(fv.BROKEN).alias("risk"),
        F.when(small, fv.REC_RSA_SHORT + fv.REC_RSA).otherwise(fv.REC_RSA).alias("advice"),
        F.when(small, F.array(F.lit("undersized-classical-key")))
        .otherwise(F.array().cast("array<string>")).alias("tags"),
    )


def ecc_profile(curve: Column, purpose: str = "signature") -> Column:
    """(label, severity, risk, advice) of a curve key (P10)."""
    word = "ECDSA (" if purpose == "signature" else "ECDH ("
    return F.struct(
        F.concat(F.lit(word), curve, F.lit(")")).alias("label"), F.lit("Medium").alias("severity"),
        F.lit(fv.BROKEN).alias("risk"), F.lit(fv.REC_ECC).alias("advice"),
    )


def dsa_profile(bits: Column) -> Column:
    return F.struct(
        F.when(F.coalesce(bits, F.lit(0)) != 0, F.concat(F.lit("DSA-"), bits.cast("string")))
        .otherwise("DSA").alias("label"),
        F.when((bits > 0) & (bits < 2048), "High").otherwise("Medium").alias("severity"),
        F.lit(fv.BROKEN).alias("risk"), F.lit(fv.REC_DSA).alias("advice"),
    )


def hash_profile(algo: Column) -> Column:
    """Profile of a hash by its key, null when it is not a known one."""
    known = F.create_map(*[
        x for key, profile in fv.HASH_PROFILES.items()
        for x in (F.lit(key), F.struct(*[v.alias(k) for k, v in _fixed(profile).items()]))
    ])
    return F.try_element_at(known, algo)


def _hash_hit(language: str) -> Column:
    """Weak hash, or any raw hash of a password (D01, D11); reads _hash, _hash_profile, _password."""
    password, label = F.col("_password"), F.col("_hash_profile")["label"]
    strong = F.col("_hash").isin("sha256", "sha3", "sha512")
    message = F.concat(
        label, F.lit(" used"), F.when(password, " for password hashing").otherwise(""),
        F.lit(" at line "), F.col("line").cast("string"), F.lit("."))
    kind = F.when(password, "weak-password-hash").otherwise("hashing")
    return hit(
        F.col("_hash_profile").isNotNull() & (password | ~strong),
        F.concat(F.col("_hash"), F.lit("-"), kind), F.concat(label, F.lit(" "), kind), "hash",
        _of("_hash_profile"), specificity=F.when(password, 3).otherwise(2),
        message=message if language == "python" else None,
    )


def _aes_stage(rows: DataFrame) -> DataFrame:
    """Red flags and label text of one AES construction; reads _bits, _mode, _hard, _fixed_iv."""
    flags = F.array_compact(F.array(
        F.when(F.col("_hard"), "hardcoded-key"), F.when(F.col("_fixed_iv"), "static-iv")))
    return rows.withColumns({
        "_aes": symmetric_profile(F.lit("AES"), F.col("_mode"), F.col("_bits")),
        "_flags": F.array_join(flags, ", "),
        "_size": F.concat(
            F.lit("AES-"), F.coalesce(F.col("_bits").cast("string"), F.lit("None")), F.lit("-")),
    })


def _aes_hits(is_aes: Column, other_name) -> list[Column]:
    """The findings of one AES construction."""
    mode, size, flags = F.col("_mode"), F.col("_size"), F.col("_flags")
    plain = F.coalesce(mode.isin(fv.UNAUTHENTICATED_MODES), F.lit(False))
    flagged = flags != ""
    profile = _of("_aes")
    aead = F.coalesce(mode.isin("GCM", "CCM"), F.lit(False))
    ecb = F.coalesce(mode == "ECB", F.lit(False))
    sym = "symmetric-cipher"
    return [
        hit(is_aes & F.col("_hard"), "aes-hardcoded-key",
            F.concat(size, F.coalesce(mode, F.lit("?")), F.lit(" hardcoded-key")),
            "hardcoded-secret", _fixed(fv.HARDCODED_KEY), 4),
        hit(is_aes & F.col("_fixed_iv") & (plain | (mode == "GCM")), "aes-static-iv-reuse",
            F.concat(size, mode, F.lit(" static-iv-reuse")), sym, _fixed(fv.STATIC_IV), 4),
        hit(is_aes & ecb, "aes-ecb-mode", F.concat(size, F.lit("ECB")), sym, profile, 3),
        hit(is_aes & plain, "aes-missing-aead", F.concat(size, mode, F.lit(" missing-aead")), sym,
            profile, 2, generic=~flagged,
            severity=F.when(flagged, "Critical").otherwise(profile["severity"]),
            advice=F.when(flagged, F.concat(
                F.lit("Combined with "), flags, F.lit(", " + fv.REC_RED_FLAGS),
                profile["advice"])).otherwise(profile["advice"])),
        hit(is_aes & aead, "aes-aead-mode", F.concat(size, mode), sym, profile, 1, True),
        hit(is_aes & ~ecb & ~plain & ~aead, "aes-encryption", other_name, sym, profile, 1, True),
    ]


def _deprecated(condition: Column, algo: Column, profile: str) -> Column:
    return hit(
        condition, F.concat(F.lower(algo), F.lit("-deprecated-cipher")),
        F.concat(algo, F.lit(" deprecated-cipher")), "symmetric-cipher", _of(profile), 3)


def _mentions_password(snippet: Column) -> Column:
    return F.lower(snippet).rlike("password|pwd|passwd")


def _assigned_name(snippet: Column, drop: str | None = None) -> Column:
    """Identifier left of the first = of the line, if it is just that."""
    left = F.substring_index(snippet, "=", 1)
    left = p.strip(left if drop is None else F.regexp_replace(left, drop, ""))
    return F.when(snippet.contains("=") & left.rlike(r"^[^\W\d]\w*$"), left)


def _dotted_head(call: Column) -> Column:
    """Last part of the name of a nested call, '' when the text is not a call."""
    return F.substring_index(F.regexp_extract(call, r"^([\w.]+)\(", 1), ".", -1)


# --- Python -------------------------------------------------------------------
PYTHON_CALLEE = (
    r"^(?:hashlib\.)?(?:md5|sha1|sha256|sha3_256|sha512)$|^hashlib\.new$|^hmac\.new$|"
    r"^(?:AES|DES|DES3|TDES|RC2|RC4|ARC4|Blowfish|Crypto|Cryptodome)\b.*\.new$|"
    r"^Cipher$|^Fernet$|^RSA\.generate$|newkeys$|generate_private_key$|^DSA\.generate$|^random\."
)


def python_findings(sites: DataFrame) -> DataFrame:
    name, snippet = F.col("callee"), F.col("snippet")
    arg0, mode_arg = F.col("arg0_value"), F.col("mode_arg")
    tail = F.substring_index(name, ".", -1)
    head = F.substring_index(name, ".", 1)
    dotted = F.split(name, r"\.")
    null_int = F.lit(None).cast("int")
    rows = sites.withColumns({
        "_hash": F.when(
            name.isin(fv.PY_HASH_CALLS), F.when(tail == "sha3_256", "sha3").otherwise(tail)
        ).when(name == "hashlib.new", F.lower(literal_text(arg0))),
        "_password": p.is_secret_name(snippet) & _mentions_password(snippet),
        "_new": name.endswith(".new") & head.isin(fv.PY_CIPHER_HEADS),
        "_cipher": F.when(head.isin("Crypto", "Cryptodome"), F.get(dotted, F.size(dotted) - 2))
        .otherwise(head),
        "_mode": F.nullif(F.regexp_extract(mode_arg, r"^[\w.]*\.MODE_(\w+)$", 1), F.lit("")),
        "_bits": key_bits(arg0, F.col("arg0_size")),
        "_hard": F.coalesce(F.col("arg0_size") > 0, F.lit(False)),
        "_fixed_iv": F.col("iv_size").isNotNull(),
        "_algo": _dotted_head(F.col("arg0")),
        "_algo_mode": F.upper(F.nullif(_dotted_head(mode_arg), F.lit(""))),
        "_inner_bits": key_bits(F.col("inner_value"), F.col("inner_size")),
        "_digest": F.regexp_extract(F.coalesce(
            F.concat(F.lit("hashlib."), F.lower(literal_text(F.col("digest")))), F.col("digest")),
            r"^hashlib\.(md5|sha1)$", 1),
        "_bits0": literal_int(arg0),
        "_key_size": literal_int(F.col("size_value")),
        "_secret_place": p.is_secret_name(
            F.when(~snippet.startswith("if"), _assigned_name(snippet)))
        | p.is_secret_name(F.col("function")),
    })
    generated = name.isin("rsa.generate_private_key", "generate_private_key")
    curve = F.when(F.col("_algo") != "", F.col("_algo")).otherwise("unknown-curve")
    rows = _aes_stage(rows).withColumns({
        "_hash_profile": hash_profile(F.col("_hash")),
        "_mac_profile": hash_profile(F.col("_digest")),
        "_legacy": symmetric_profile(F.col("_cipher"), F.col("_mode"), null_int),
        "_composed": symmetric_profile(
            F.col("_algo"), F.col("_algo_mode"),
            F.when(F.upper("_algo") == "AES", F.col("_inner_bits"))),
        "_rsa": rsa_profile(F.when(generated, F.col("_key_size")).otherwise(F.col("_bits0"))),
        "_ecc": ecc_profile(curve),
        "_dsa": dsa_profile(F.coalesce("_key_size", "_bits0")),
        "_inner_size": F.concat(
            F.lit("AES-"), F.coalesce(F.col("_inner_bits").cast("string"), F.lit("?")), F.lit("-")),
    })
    new, cipher, mode = F.col("_new"), F.col("_cipher"), F.col("_algo_mode")
    composed = (name == "Cipher") & (F.col("_algo") != "")
    aes = composed & (F.upper("_algo") == "AES")
    inner, sym = F.col("_inner_size"), "symmetric-cipher"
    return explode_hits(rows, [
        _hash_hit("python"),
        _deprecated(new & cipher.isin(fv.PY_LEGACY_CIPHERS), cipher, "_legacy"),
        *_aes_hits(new & (cipher == "AES"), "AES encryption"),
        _deprecated(composed & F.upper("_algo").isin(fv.PY_COMPOSED_LEGACY), F.col("_algo"), "_composed"),
        hit(aes & (mode == "ECB"), "aes-ecb-mode", F.concat(inner, F.lit("ECB")), sym, _of("_composed"), 3),
        hit(aes & mode.isin(fv.UNAUTHENTICATED_MODES), "aes-missing-aead",
            F.concat(inner, mode, F.lit(" missing-aead")), sym, _of("_composed"), 2, True),
        hit(aes & mode.isin("GCM", "CCM"), "aes-aead-mode", F.concat(inner, mode), sym,
            _of("_composed"), 1, True),
        hit(name == "Fernet", "fernet-aes128-cbc-hmac", "Fernet symmetric encryption", sym,
            _fixed(fv.FERNET), 2),
        hit((name == "hmac.new") & F.col("_mac_profile").isNotNull(),
            F.concat(F.col("_digest"), F.lit("-hmac-weak-digest")),
            F.concat(F.lit("HMAC-"), F.col("_mac_profile")["label"], F.lit(" weak-digest")), "hash",
            _of("_mac_profile"), 3),
        hit(name.isin("RSA.generate", "rsa.newkeys", "newkeys") | (name == "rsa.generate_private_key")
            | ((name == "generate_private_key") & (F.col("_key_size") > 0)),
            "rsa-key-generation", "RSA key_generation", "asymmetric", _of("_rsa"), 2,
            tags=F.col("_rsa")["tags"]),
        hit(name == "ec.generate_private_key", "ecdsa-key-generation",
            F.concat(F.lit("ECDSA key_generation ("), curve, F.lit(")")), "asymmetric", _of("_ecc"), 2),
        hit(name.isin("dsa.generate_private_key", "DSA.generate"), "dsa-key-generation",
            "DSA key_generation", "asymmetric", _of("_dsa"), 2),
        hit(name.isin(fv.PY_RANDOM_CALLS) & F.col("_secret_place"), "insecure-rng",
            "random module insecure-rng", "rng", _fixed(fv.INSECURE_RNG), 3),
        _comparison_hit("python"),
    ], "python")


def _comparison_hit(language: str) -> Column:
    """Equality test on a secret-named operand."""
    constants = ["None", "True", "False"] if language == "python" else ["null", "true", "false"]

    def name_of(side: str) -> Column:
        c = F.col(side)
        plain = c.rlike(r"^[A-Za-z_$][\w$.]*$") & ~c.isin(constants)
        return F.when(plain, F.substring_index(c, ".", -1)).otherwise("")

    def quiet(side: str) -> Column:
        trivial = F.col(side).isin("''", '""', "0", "0.0", constants[0], constants[2])
        return trivial | F.lower(name_of(side)).isin(fv.NON_SECRET_PROPS)

    secret = p.is_secret_name(name_of("left")) | p.is_secret_name(name_of("right"))
    if language == "javascript":
        secret = secret | p.is_secret_name(F.col("function"))
    return hit(
        (F.col("callee") == EQUALITY) & ~quiet("left") & ~quiet("right") & secret,
        "timing-unsafe-compare", "Non-constant-time secret comparison", "comparison",
        _fixed(fv.TIMING_COMPARE), 3)


def detect_python(files: DataFrame) -> DataFrame:
    own = files.filter(F.lower("path").endswith(".py") & F.col("text").rlike(PYTHON_MAYBE))
    return python_findings(call_sites(own, "python", PYTHON_CALLEE, True))


# --- JavaScript ---------------------------------------------------------------
def _js_fixed(value: Column, size: Column, strings_only: bool) -> Column:
    """A literal, or a buffer made from one."""
    literal = size.isNotNull()
    if not strings_only:
        literal = literal | value.rlike(r"^(?:null|true|false|-?\d[\w.]*)$")
    buffered = value.rlike(r"^Buffer\.from\(\s*(?:[\"']|null\b|true\b|false\b|\d)")
    return F.coalesce(literal | buffered, F.lit(False))


def javascript_findings(sites: DataFrame) -> DataFrame:
    name, snippet, path = F.col("callee"), F.col("snippet"), F.lower("path")
    options = F.col("arg1_value")
    rows = sites.withColumn("_arg0", F.when(F.col("arg0_own_size").isNotNull(), F.regexp_replace("arg0", r"^[\"']|[\"']$", "")))
    rows = rows.withColumn("_parsed", tx.split_cipher(F.col("_arg0")))
    scheme = F.upper(F.coalesce("_arg0", F.lit("")))
    by_rsa = scheme.contains("RSA") | (path.contains("auth") & ~scheme.contains("EC"))
    by_ec = scheme.contains("EC") | path.contains("payment")
    library = None
    for markers, *said in fv.JS_LIBRARY_CALLS:
        value = F.struct(*[F.lit(v).alias(k) for k, v in zip(
            ("rule_id", "rule_name", "category", *PROFILE_FIELDS, "specificity"), said)])
        found = F.upper(name).rlike("|".join(markers))
        library = F.when(found, value) if library is None else library.when(found, value)
    rows = rows.withColumns({
        "_algo": F.col("_parsed.algo"), "_bits": F.col("_parsed.bits"), "_mode": F.col("_parsed.mode"),
        "_hash": F.lower("_arg0"), "_password": _mentions_password(snippet),
        "_hard": _js_fixed(options, F.col("arg1_size"), True), "_fixed_iv": _js_fixed(F.col("iv_value"), F.col("iv_size"), False),
        "_modulus": F.regexp_extract(
            options, r"modulusLength[\"']?\s*:\s*(\d+)", 1).try_cast("int"),
        "_curve": F.coalesce(F.nullif(F.regexp_extract(
            options, r"namedCurve\s*:\s*[\"']([^\"']*)[\"']", 1), F.lit("")),
            F.lit("unknown-curve")),
        "_sign_rsa": by_rsa | ~by_ec,
        "_action": F.when(F.lower(name).contains("sign"), "sign").otherwise("verify"),
        "_library": F.when(name.contains("CryptoJS") | name.startswith("algo."), library),
        "_upper": F.upper(snippet),
        "_secret_place": p.is_secret_name(_assigned_name(snippet, r"(?:const|let|var) "))
        | p.is_secret_name(F.col("function")),
    })
    rows = _aes_stage(rows).withColumns({
        "_hash_profile": F.when(name == "crypto.createHash", hash_profile(F.col("_hash"))),
        "_legacy": symmetric_profile(F.col("_algo"), F.lit(""), F.lit(None).cast("int")),
        "_rsa": rsa_profile(F.when(F.col("_arg0") == "rsa", F.col("_modulus"))),
        "_ecc": ecc_profile(F.col("_curve")),
        "_sign_profile_rsa": rsa_profile(F.lit(2048)),
        "_sign_profile_ec": ecc_profile(F.lit("secp256k1")),
    })
    is_cipher = name.isin("crypto.createCipheriv", "crypto.createDecipheriv")
    is_pair = name.isin("crypto.generateKeyPairSync", "crypto.generateKeyPair")
    is_sign = name.isin("crypto.createSign", "createSign", "crypto.createVerify", "createVerify")
    is_signature = (
        F.col("_library").isNull()
        & (name.contains("KJUR") | name.contains("Signature") | name.contains("jsrsasign")))
    sha1 = F.col("_upper").contains("SHA1")
    action, lib = F.col("_action"), F.col("_library")
    direction = F.when(name == "crypto.createCipheriv", "AES encryption").otherwise("AES decryption")
    return explode_hits(rows, [
        _hash_hit("javascript"),
        _deprecated(is_cipher & F.col("_algo").isin(fv.JS_LEGACY_CIPHERS), F.col("_algo"), "_legacy"),
        *_aes_hits(is_cipher & (F.col("_algo") == "AES"), direction),
        hit(is_pair & (F.col("_arg0") == "rsa"), "rsa-key-generation", "RSA key_generation",
            "asymmetric", _of("_rsa"), 2, tags=F.col("_rsa")["tags"]),
        hit(is_pair & (F.col("_arg0") == "ec"), "ecdsa-key-generation",
            F.concat(F.lit("ECDSA key_generation ("), F.col("_curve"), F.lit(")")), "asymmetric",
            _of("_ecc"), 2),
        hit(is_sign & F.col("_sign_rsa"), F.concat(F.lit("rsa-digital-signature-"), action),
            F.concat(F.lit("RSA-2048 digital signature ("), action, F.lit(")")), "asymmetric",
            _of("_sign_profile_rsa"), 2),
        hit(is_sign & ~F.col("_sign_rsa"), F.concat(F.lit("ecdsa-signature-"), action),
            F.concat(F.lit("ECDSA signature ("), action, F.lit(")")), "asymmetric",
            _of("_sign_profile_ec"), 2),
        hit(lib.isNotNull(), lib["rule_id"], lib["rule_name"], lib["category"],
            {k: lib[k] for k in PROFILE_FIELDS}, lib["specificity"]),
        hit(is_signature & sha1, "jsrsasign-sha1withrsa-weak-signature",
            "jsrsasign SHA1withRSA digital signature", "signature", _fixed(fv.JS_SIGNATURE_SHA1), 3),
        hit(is_signature & ~sha1 & F.col("_upper").contains("MD5WITHRSA"),
            "jsrsasign-md5withrsa-weak-signature", "jsrsasign MD5withRSA digital signature",
            "signature", _fixed(fv.JS_SIGNATURE_MD5), 3),
        hit((name == "Math.random") & F.col("_secret_place"), "insecure-rng",
            "Math.random insecure-rng", "rng", _fixed(fv.INSECURE_RNG), 3),
        _comparison_hit("javascript"),
    ], "javascript")


def detect_javascript(files: DataFrame) -> DataFrame:
    own = files.filter(
        F.lower("path").rlike(r"\.(?:js|mjs|cjs|jsx)$") & F.col("text").rlike(JS_MAYBE))
    return javascript_findings(
        call_sites(own, "javascript", JS_CALLEE, True))
