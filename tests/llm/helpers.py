"""Small inputs shared by the tests: awkward texts, and plain re-statements of the contracts."""

import re

AWKWARD = [
    None, "", " ", "\n\n", "\t\x0b\x0c \r\n", "a", "!!!", "<|endoftext|>", "x <|endoftext|><|startoftext|> y", "aaaa aaaaa aaaaaa",
    "Don't WE'LL I'm 12 345 ²½ ٣", "ΑΣ ΣΑΣ ὈΔΥΣΣΕΎΣ İstanbul ﬁ é é", "日本語テキスト。 " * 40, "\x00\x01\x1c\x1f a\x85b c",
    "😀👨‍👩‍👧 emoji", "word " * 3000, "x" * 4000, "the end\n" * 50, "Under the MIT License. under the  mit license",
]

ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def contract_words(text):
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text whose A-Z are lower-cased."""
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(ASCII_LOWER))


def space_words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def docs_with_clashes(spark, texts):
    """A documents table with null ids, repeated rows and columns named like those that operators add."""
    rows = [(i, t, "en", "src", len(t or ""), "mine", 7) for i, t in enumerate(texts)]
    rows += rows[:3] + [(None, "no id here at all but words", None, None, None, None, None)]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, made string, n_tokens int")
