"""Text expressions: tokenizers, redaction, task classes. All are JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scripts whose characters are words of their own.
CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"

# Redaction patterns and what stands in for their matches, in order.
REDACTIONS = (
    (r"sk-[A-Za-z0-9]{20,}", "[REDACTED_KEY]"),
    (r"AKIA[0-9A-Z]{16}", "[REDACTED_KEY]"),
    (r"ghp_[A-Za-z0-9]{36}", "[REDACTED_KEY]"),
    (r"xox[baprs]-[A-Za-z0-9-]{10,}", "[REDACTED_KEY]"),
    (r"(?i)\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b", "[REDACTED_EMAIL]"),
    (r"(?:/home|/Users)/[A-Za-z0-9_.\-]+", "[REDACTED_PATH]"),
    (r"(?i)C:\\Users\\[A-Za-z0-9_.\-]+", "[REDACTED_PATH]"),
)

# Task kinds by precedence, each with its keys.
TASK_KEYS = (
    ("test_update", ("test fail", "failing test", "broken test", "update test", "fix test", "assertionerror", "测试失败", "修测试", "断言失败")),
    ("bugfix", ("fix", "bug", "error", "crash", "regression", "incorrect", "wrong", "exception", "traceback", "unexpected", "fails", "broken", "修复", "报错", "崩溃", "异常", "错误", "不正确")),
    ("refactor", ("refactor", "rename", "clean up", "cleanup", "restructure", "simplify", "deduplicate", "重构", "重命名", "整理代码")),
    ("docs", ("document", "docs", "readme", "docstring", "changelog", "文档", "注释补全")),
    ("feature", ("add ", "support", "implement", "introduce", "new feature", "enable", "allow ", "新增", "支持", "实现", "增加")),
    ("investigate", ("why ", "investigate", "diagnose", "figure out", "root cause", "what happens", "为什么", "排查", "诊断", "定位原因")),
)


#: Scripts in CJK start here; texts without such characters take a plainer pattern.
_HIGH = r"[\u1100-\uFFFF\x{10000}-\x{10FFFF}]"
#: Letters, digits and underscore; the ranges are part of the classes after them, and cheaper to test.
_WORD = r"[a-z0-9_\u00DF-\u00F6\u00F8-\u00FF\p{L}\p{Nd}]+"


def _lower(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores; a CJK character is a token of its own."""
    full = rf"[{CJK}]|[\p{{L}}\p{{Nd}}_&&[^{CJK}]]+"
    every = lambda p: F.regexp_extract_all(_lower(text), F.lit(p), F.lit(0))
    return F.when(F.coalesce(text, F.lit("")).rlike(_HIGH), every(full)).otherwise(every(_WORD))


def bigram_tokens(text: Column) -> Column:
    """As tokens, but a run of CJK characters gives its pairs; a lone character stays."""
    runs = F.regexp_extract_all(_lower(text), F.lit(rf"[{CJK}]+|[\p{{L}}\p{{Nd}}_&&[^{CJK}]]+"), F.lit(0))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    cut = F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^[{CJK}]{{2,}}$"), pairs(r)).otherwise(F.array(r))))
    return F.when(F.coalesce(text, F.lit("")).rlike(_HIGH), cut).otherwise(F.regexp_extract_all(_lower(text), F.lit(_WORD), F.lit(0)))


def ascii_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits in their own case, and CJK characters: what the hash embedding counts."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[A-Za-z0-9]+|[{CJK}]"), F.lit(0))


def symbol_tokens(text: Column) -> Column:
    """Words, and for each word of two or more segments (by case, underscore or digit) its segments over one character."""
    cased = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z0-9_\p{L}\p{Nd}]+"), F.lit(0))

    def parts(w: Column) -> Column:
        marked = F.regexp_replace(F.regexp_replace(w, r"(\p{Ll}|\p{Nd})(\p{Lu})", "$1 $2"), r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
        marked = F.regexp_replace(F.regexp_replace(marked, r"(\p{L})(\p{Nd})", "$1 $2"), r"(\p{Nd})(\p{L})", "$1 $2")
        cut = F.filter(F.split(marked, r"[ _]+"), lambda x: F.length(x) > 0)
        return F.when(F.size(cut) >= 2, F.filter(F.transform(cut, lambda x: F.lower(x)), lambda x: F.length(x) > 1)).otherwise(F.array().cast("array<string>"))

    # A word without a digit, an underscore or a capital inside is one segment; most are, and need not be cut.
    every = lambda w: F.when(w.rlike(r"[0-9_\p{Nd}]|.\p{Lu}"), F.concat(F.array(F.lower(w)), parts(w))).otherwise(F.array(F.lower(w)))
    return F.flatten(F.transform(cased, every))


def normalized(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\t\n\x0B\f\r ]+", " "))


def redacted(text: Column) -> Column:
    """Keys, mail addresses and home folders replaced by fixed marks."""
    for pattern, mark in REDACTIONS:
        text = F.regexp_replace(text, pattern, mark.replace("\\", "\\\\"))
    return text


def task_kind(text: Column) -> Column:
    """The first kind in TASK_KEYS with a key in the text; ASCII ends of a key need a border of a word."""
    lower = F.lower(F.coalesce(text, F.lit("")))

    def pattern(key: str) -> str:
        word = "[a-z0-9_]"
        inside = lambda c: c.isascii() and (c.isalnum() or c == "_")
        return (f"(?<!{word})" if inside(key[0]) else "") + key + (f"(?!{word})" if inside(key[-1]) else "")

    out = F.lit("general")
    for kind, keys in reversed(TASK_KEYS):
        out = F.when(lower.rlike("|".join(map(pattern, keys))), kind).otherwise(out)
    return out


def task_tag(content: Column) -> Column:
    """What follows task= in a text's first line, of small letters, digits, - and _; empty without a tag."""
    head = F.substring_index(F.coalesce(content, F.lit("")), "\n", 1)
    return F.regexp_extract(head, r"task=([-_0-9a-z]*)", 1)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of an ASCII text, as a long."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    step = lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), step)


def provider(model: Column) -> Column:
    """What stands before the slash of a model reference, or default."""
    return F.when(F.instr(model, "/") > 1, F.substring_index(model, "/", 1)).otherwise(F.lit("default"))


def safe_cell(text: Column) -> Column:
    """A cell for a tab-separated file: control characters become blanks, a leading formula sign is quoted."""
    plain = F.regexp_replace(text, r"[\x00-\x1F\x7F]", " ")
    return F.when(plain.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), plain)).otherwise(plain)


def slice_id(kind: Column, scope: Column, content: Column) -> Column:
    """The first 16 hex digits of sha256(type byte, scope byte, content)."""
    byte = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 2, "0"))
    return F.substring(F.sha2(F.concat(byte(kind), byte(scope), F.encode(content, "UTF-8")), 256), 1, 16)


def snippet(text: Column, term: Column, width: int = 160) -> Column:
    """A window of the compacted text around the first place of a term, with dots where it is cut."""
    flat = normalized(text)
    at = F.greatest(F.instr(F.lower(flat), term) - width // 2, F.lit(1))
    cut = F.substring(flat, at, F.lit(width))
    return F.concat(F.when(at > 1, "...").otherwise(""), cut, F.when(at + width - 1 < F.length(flat), "...").otherwise(""))
