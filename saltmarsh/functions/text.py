"""Lines, assignments, key/value pairs and call sites out of whole texts.

All of it runs inside one row of the files table, so nothing here shuffles. Group
repetitions in patterns are possessive: Java matches those in a loop, so a literal with
thousands of escapes cannot exhaust the stack of a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.functions.predicates import basename, extension, strip, strip_chars

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
# Noncharacters that no valid text holds; they carry a line number through a match.
OPEN, CLOSE = "\ufdd0", "\ufdd1"
TAG = OPEN + r"(\d++)(c?)" + CLOSE
ANY_TAG = OPEN + r"\d++c?" + CLOSE


def let(value: Column, build) -> Column:
    """``build`` of a value that is worked out once, however often it is read."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


# --- lines --------------------------------------------------------------------
def to_lines(files: DataFrame, text: str = "text") -> DataFrame:
    """One row per line, numbered from 1."""
    keep = [c for c in files.columns if c != text]
    return files.select(
        *keep, F.posexplode(F.split(text, LINE_BREAK)).alias("_pos", "raw")
    ).select(*keep, (F.col("_pos") + 1).alias("line"), "raw")


COMMENT_MARKS = {
    "docker": r"^\s*#", "env": r"^\s*[#;]", "ini": r"^\s*[#;]", "yaml": r"^\s*(?:#|//)",
    "web": r"^\s*#", "terraform": r"^\s*(?:#|//)", "python": r"^\s*#",
    "javascript": r"^\s*(?://|/\*|\*)", "pip": r"^\s*[#-]",
}


def is_code(raw: Column, fmt: str) -> Column:
    """Neither blank nor a comment line of the format."""
    return raw.rlike(r"\S") & ~raw.rlike(COMMENT_MARKS[fmt])


def drop_comments(lines: DataFrame, fmt: str, raw: str = "raw") -> DataFrame:
    return lines.filter(is_code(F.col(raw), fmt))


def language_of(path: Column) -> Column:
    ext = extension(path)
    return (
        F.when(ext == ".py", "python")
        .when(ext.isin(".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx"), "javascript")
        .otherwise("config")
    )


# --- literal assignments over whole texts -------------------------------------
# A name starts where no letter, digit or underscore precedes it.
_EDGE = r"(?:(?m:^)[ \t]*|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_])|(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_]))"
_DQ = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"'
_SQ = r"'([^'\\]*+(?:\\.[^'\\]*+)*+)'"
_BQ = r"`([^`\\]*+(?:\\.[^`\\]*+)*+)`"
_PY_NAME = r"([A-Za-z_][A-Za-z0-9_]*)[ \t]*"
_JS_NAME = r"(?i:const|let|var)?[ \t]*([A-Za-z_$][A-Za-z0-9_$]*)[ \t]*"
ASSIGNMENT = {
    # opening up to the quote (for tagging), and the whole assignment around a tag
    "python": (
        r"(=[ \t]*(?:[brufBRUF]{1,2})?)([\"'])",
        _EDGE + _PY_NAME + r"=[ \t]*(?:[brufBRUF]{1,2})?" + TAG + f"(?:{_DQ}|{_SQ})",
        r"^\s*#",
    ),
    "javascript": (
        r"([:=][ \t]*)([\"'`])",
        _EDGE + _JS_NAME + r"[:=][ \t]*" + TAG + f"(?:{_DQ}|{_SQ}|{_BQ})",
        r"^\s*(?://|/\*|\*)",
    ),
}
_MAYBE = {"python": r"=[ \t]*[brufBRUF]{0,2}[\"']", "javascript": r"[:=][ \t]*[\"'`]"}


def assignments_in(text: Column, language: str) -> Column:
    """Array of (line, name, value) for every string literal bound to a name.

    A literal may span lines, so the pattern runs over the whole text. Each opening quote
    first gets a tag with its line number, which the match then carries out.
    """
    opening, pattern, comment = ASSIGNMENT[language]

    def tagged(raw: Column, i: Column) -> Column:
        tag = F.concat(
            F.lit("$1" + OPEN), (i + 1).cast("string"),
            F.when(raw.rlike(comment), F.lit("c")).otherwise(F.lit("")), F.lit(CLOSE + "$2"),
        )
        return F.when(raw.rlike(opening), F.regexp_replace(raw, F.lit(opening), tag)).otherwise(raw)

    whole = F.array_join(F.transform(F.split(text, "\n"), tagged), "\n")
    hits = F.regexp_extract_all(whole, F.lit(pattern), F.lit(0))

    def parts(hit: Column) -> Column:
        value = F.concat(*[F.regexp_extract(hit, pattern, g) for g in range(4, 7 if language == "javascript" else 6)])
        value = F.regexp_replace(value, ANY_TAG, "")
        value = F.replace(F.replace(value, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))
        return F.struct(
            F.regexp_extract(hit, pattern, 2).cast("int").alias("line"),
            F.regexp_extract(hit, pattern, 1).alias("name"),
            value.alias("value"),
            (F.regexp_extract(hit, pattern, 3) == "c").alias("comment"),
        )

    found = F.filter(F.transform(hits, parts), lambda a: ~a["comment"])
    none = F.array().cast("array<struct<line:int,name:string,value:string,comment:boolean>>")
    return F.when(text.rlike(_MAYBE[language]), found).otherwise(none)


def env_assignment(raw: Column) -> Column:
    """(name, value) of a ``NAME=value`` line, or null."""
    line = strip(raw)
    name = strip(F.substring_index(line, "=", 1))
    rest = strip(F.regexp_replace(line, r"^[^=]*=", ""))
    quoted = F.coalesce(
        F.when(rest.rlike('^"[^"]*"'), F.regexp_extract(rest, '^"([^"]*)"', 1)),
        F.when(rest.rlike("^'[^']*'"), F.regexp_extract(rest, "^'([^']*)'", 1)),
    )
    value = F.coalesce(quoted, strip(F.substring_index(rest, " #", 1)))
    ok = is_code(raw, "env") & line.contains("=") & name.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$")
    return F.when(ok, F.struct(name.alias("name"), value.alias("value")))


def assignments(files: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
    """(…, language, line, name, value) rows, routed by the language of the file."""
    keep = [c for c in files.columns if c != text]
    lang = language_of(F.col(path))
    env_lines = F.filter(
        F.transform(
            F.split(text, LINE_BREAK),
            lambda raw, i: F.struct(
                (i + 1).alias("line"),
                env_assignment(raw)["name"].alias("name"),
                env_assignment(raw)["value"].alias("value"),
                F.lit(False).alias("comment"),
            ),
        ),
        lambda a: a["name"].isNotNull(),
    )
    found = (
        F.when(lang == "python", assignments_in(F.col(text), "python"))
        .when(lang == "javascript", assignments_in(F.col(text), "javascript"))
        .otherwise(env_lines)
    )
    return files.select(
        *keep, lang.alias("language"), F.posexplode(found).alias("seq", "a")
    ).select(*keep, "language", "seq", "a.line", "a.name", "a.value")


# --- configuration key/value lines --------------------------------------------
def key_value(raw: Column, fmt: str) -> Column:
    """(instruction, key, value) of a configuration line, or null."""
    line = strip(raw)
    quote_first = r"^[\"']"
    if fmt == "docker":
        pattern = r"(?i)^[ \t]*(ENV|ARG)[ \t]+([A-Za-z0-9_\-]+)[ \t]*[= \t]+([^\n#]+)"
        ok = raw.rlike(pattern)
        word = F.regexp_extract(raw, pattern, 1)
        key = F.regexp_extract(raw, pattern, 2)
        value = strip_chars(strip(F.regexp_extract(raw, pattern, 3)), "\"'")
    elif fmt == "env":
        ok, word = line.contains("="), F.lit(None).cast("string")
        key = strip(F.substring_index(line, "=", 1))
        rest = strip(F.regexp_replace(line, r"^[^=]*=", ""))
        bare = F.when(rest.rlike(quote_first), rest).otherwise(
            strip(F.substring_index(rest, " #", 1))
        )
        value = strip_chars(bare, "\"'")
    elif fmt == "yaml":
        pattern = r"^[ \t{]*[\"']?([A-Za-z0-9_.\-]+)[\"']?[ \t]*:[ \t]*(.+)$"
        ok, word = raw.rlike(pattern), F.lit(None).cast("string")
        key = F.regexp_extract(raw, pattern, 1)
        rest = strip(F.regexp_extract(raw, pattern, 2))
        bare = F.when(rest.rlike(quote_first), rest).otherwise(
            strip(F.substring_index(rest, " #", 1))
        )
        value = strip_chars(bare, ",\"'")
        closed = value.endswith("}") & ~value.startswith("${") & ~value.startswith("{{")
        value = F.when(
            closed, strip_chars(F.regexp_replace(value, r"}+$", ""), ",\"'")
        ).otherwise(value)
    elif fmt == "ini":
        pattern = r"^[ \t]*([A-Za-z0-9_.\-]+)[ \t]*[=:][ \t]*(.+)$"
        ok, word = raw.rlike(pattern), F.lit(None).cast("string")
        key = F.regexp_extract(raw, pattern, 1)
        rest = strip(F.regexp_extract(raw, pattern, 2))
        rest = strip(F.substring_index(rest, " #", 1))
        rest = strip(F.substring_index(rest, " ;", 1))
        value = strip_chars(rest, "\"'")
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return F.when(
        ok & is_code(raw, fmt),
        F.struct(word.alias("word"), key.alias("key"), value.alias("value")),
    )


# --- cipher names and kinds of files --------------------------------------------
def split_cipher(name: Column) -> Column:
    """'aes-256-cbc' -> (AES, 256, CBC); other names give (HEAD, null, LAST)."""
    parts = F.split(name, "-")
    head = F.upper(F.get(parts, F.lit(0)))
    is_aes = (head == "AES") & (F.size(parts) >= 3)
    last = F.when(F.size(parts) > 1, F.upper(F.get(parts, F.size(parts) - 1)))
    return F.when(
        F.length(name) > 0,
        F.struct(
            head.alias("algo"),
            F.when(is_aes, F.get(parts, F.lit(1)).try_cast("int")).alias("bits"),
            F.when(is_aes, F.upper(F.get(parts, F.lit(2)))).otherwise(last).alias("mode"),
        ),
    )


def file_kind(path: Column) -> Column:
    """Configuration format of a file, or null."""
    base = basename(path)
    low = F.lower(base)
    ext = extension(path)
    return (
        F.when(low.contains("dockerfile"), "docker")
        .when((base == ".env") | base.startswith(".env.") | base.endswith(".env"), "env")
        .when(ext.isin(".yml", ".yaml"), "yaml")
        .when(
            F.lower(path).endswith(".json")
            & ~low.isin("package.json", "package-lock.json", "composer.json"),
            "yaml",
        )
        .when(ext.isin(".ini", ".conf", ".cfg", ".properties", ".toml"), "ini")
    )
