"""Column functions: identifiers and token lists, similarity, scores, gates, paths. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F





def joined_hash(*parts: Column) -> Column:
    """SHA-256, in hex, of NUL-joined parts."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def split_camel(text: Column) -> Column:
    return F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")


def identifier_tokens(text: Column) -> Column:
    """camelCase and punctuated identifiers as lower-case words with single blanks."""
    spaced = F.regexp_replace(split_camel(text), r"[_\-.#/\\:]+", " ")
    return F.lower(F.trim(F.regexp_replace(spaced, r"\s+", " ")))


def query_terms(text: Column, most: int = 20) -> Column:
    """The first terms of a search, split on what is no letter, digit, underscore or dollar."""
    return F.slice(F.filter(F.split(text, r"[^\p{L}\p{N}_$]+"), lambda t: t != ""), 1, most)


def estimated_tokens(text: Column) -> Column:
    """A third of the UTF-8 bytes, rounded up, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(text) / 3)).cast("long")


def clamp_text(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def redundancy_tokens(text: Column) -> Column:
    plain = F.regexp_replace(text, r"(?i)^\s*(?:query|passage)\s*:\s*", "")
    return plain_tokens(plain)


def plain_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, split where the case changes."""
    return F.regexp_extract_all(F.lower(split_camel(text)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def shingles(tokens: Column, width: int = 5) -> Column:
    """Hashes of the distinct ``width``-token windows of a token list; empty if it is shorter."""
    n = F.size(tokens) - (width - 1)
    shifted = F.arrays_zip(*(F.slice(tokens, k + 1, F.greatest(n, F.lit(0))).alias(f"t{k}") for k in range(width)))
    windows = F.transform(shifted, lambda w: F.xxhash64(*(w[f"t{k}"] for k in range(width))))
    return F.when(n > 0, F.array_distinct(windows)).otherwise(F.array().cast("array<bigint>"))


def set_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two arrays of distinct values; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def text_redundancy(a: Column, b: Column) -> Column:
    """Likeness of two token lists: 1 if equal, shingles if both are long enough, else token sets."""
    by_words = set_jaccard(F.array_distinct(a), F.array_distinct(b))
    by_shingles = set_jaccard(shingles(a), shingles(b))
    empty = (F.size(a) == 0) & (F.size(b) == 0)
    return (
        F.when(empty, 0.0).when(a == b, 1.0).when((F.size(a) >= 5) & (F.size(b) >= 5), by_shingles).otherwise(by_words)
    )


def dot(a: Column, b: Column) -> Column:
    """Products of float components, summed in double from left to right."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def vector_state(a: Column, dimension: int) -> Column:
    """Why a stored vector can't be used, or 'ok'."""
    return (
        F.when(a.isNull(), "missing")
        .when(F.size(a) != dimension, "dimension")
        .when(F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite")
        .when(norm(a) == 0, "zero")
        .when(F.abs(norm(a) - 1) > 0.001, "norm")
        .otherwise("ok")
    )


def quantised(value: Column, steps: int = 1_000_000) -> Column:
    """Rounded to 1 / steps, halves upward."""
    return F.floor(value * steps + 0.5) / steps


def rank_bucket(value: Column) -> Column:
    """The sort bucket of a score, a thousandth wide."""
    return F.floor(value * 1000 + 0.5).cast("long")


def cosine_redundancy(similarity: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (similarity + 1) / 2))


def overlaps(from_a: Column, to_a: Column, from_b: Column, to_b: Column) -> Column:
    """Half-open intervals; a null end is open."""
    return (to_a.isNull() | (from_b < to_a)) & (to_b.isNull() | (from_a < to_b))


# Weights of a record's utility, and the order of validation states.
ASSERTION_WEIGHT = {"verified": 180, "observed": 100, "inferred": 40, "rejected": -1000}
TYPE_WEIGHT = {"decision": 100, "procedure": 100, "fact": 60, "preference": 60, "relation": 60, "error": 30, "episode": 0}
VALIDATION_WEIGHT = {"unlinked": 0, "valid": 120, "relocated": 80, "needs_review": -200, "stale": -350, "orphaned": -450, "contradicted": -1000}
DECAY = {"decision": 10, "procedure": 10, "fact": 20, "preference": 20, "relation": 20}
SEVERITY = {"unlinked": 0, "valid": 1, "relocated": 2, "needs_review": 3, "orphaned": 4, "stale": 5, "contradicted": 6}


def looked_up(table: dict, key: Column, default=None) -> Column:
    pairs = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(pairs[key], F.lit(default)) if default is not None else pairs[key]


def utility(
    importance: Column, assertion: Column, kind: Column, validation: Column, anchor: Column, accesses: Column, basis: Column, now: Column
) -> Column:
    """0 to 1000: importance, standing, kind, links and use, less a decay for each full 30 days since ``basis``."""
    # Full days by the microsecond: times cut to seconds first could count a block that is not over yet.
    age = F.greatest(F.lit(0), F.floor(F.timestamp_diff("DAY", basis, now) / 30))
    decay = F.when(anchor, 5).otherwise(looked_up(DECAY, kind, 40))
    score = (
        importance * 120
        + looked_up(ASSERTION_WEIGHT, assertion)
        + F.when(anchor, 160).otherwise(0)
        + looked_up(TYPE_WEIGHT, kind)
        + F.least(F.lit(100), accesses * 5)
        + looked_up(VALIDATION_WEIGHT, validation)
        - age * decay
    )
    lost = (assertion == "rejected") | (validation == "contradicted")
    return F.when(lost, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(1000), score))).cast("long")


def ineligible_reason(
    state: Column, expires: Column, valid_from: Column, valid_to: Column, assertion: Column, validation: Column, maintenance: Column, now: Column
) -> Column:
    """The first rule that keeps a record from being recalled, or null."""
    return (
        F.when(state != "active", "LIFECYCLE_INACTIVE")
        .when(expires <= now, "LIFECYCLE_EXPIRED")
        .when(valid_from > now, "NOT_YET_VALID")
        .when(now >= valid_to, "VALIDITY_ENDED")
        .when(assertion == "rejected", "ASSERTION_REJECTED")
        .when(~validation.isin("unlinked", "valid", "relocated"), F.concat(F.lit("VALIDATION_"), F.upper(validation)))
        .when(maintenance == "review_required", "MAINTENANCE_REVIEW_REQUIRED")
    )


def static_path(value: Column) -> Column:
    """A literal URL path without query, doubled or trailing slashes; null if it is no such path."""
    trimmed = F.trim(value)
    bare = F.regexp_extract(trimmed, r"^[^?#]*", 0)
    single = F.regexp_replace(bare, "/{2,}", "/")
    short = F.when(F.length(single) > 1, F.regexp_replace(single, "/+$", "")).otherwise(single)
    refused = (
        (trimmed == "")
        | trimmed.startswith("//")
        | trimmed.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
        | trimmed.contains("\\")
        | trimmed.rlike(r"\$\{|[{}<>*]")
        | ~bare.startswith("/")
        | bare.rlike(r"(^|/):[^/]+")
    )
    return F.when(~refused, F.when(short == "", "/").otherwise(short))


def named_resource(value: Column) -> Column:
    """A name of at most 240 plain characters, or null."""
    trimmed = F.trim(value)
    return F.when(trimmed.rlike(r"^[A-Za-z0-9._:/-]{1,240}$"), trimmed)


_TABLE = r"([a-z_][a-z0-9_$]*(?:\.[a-z_][a-z0-9_$]*)?)"


def classified_sql(statement: Column) -> Column:
    """struct(role, operation, resource) of a single statement on one table, or null."""
    flat = F.trim(F.regexp_replace(statement, r"\s+", " "))
    parts = F.filter(F.transform(F.split(flat, ";"), lambda p: F.trim(p)), lambda p: p != "")
    one = F.lower(F.element_at(parts, 1))
    out = F.lit(None).cast("struct<role:string,operation:string,resource:string>")
    for role, operation, pattern in (
        ("writer", "delete", rf"^delete from {_TABLE}"),
        ("writer", "update", rf"^update {_TABLE}"),
        ("writer", "insert", rf"^insert into {_TABLE}"),
        ("reader", "read", rf"^select\b.*?\bfrom {_TABLE}"),
    ):
        table = F.regexp_extract(one, pattern, 1)
        found = F.struct(F.lit(role).alias("role"), F.lit(operation).alias("operation"), table.alias("resource"))
        out = F.when(table != "", found).otherwise(out)
    return F.when(F.size(parts) == 1, out)


# Which family a language belongs to, and which language a file extension means, in order.
FAMILY = {
    "typescript": "typescript/javascript", "tsx": "typescript/javascript", "javascript": "typescript/javascript", "jsx": "typescript/javascript",
    "mjs": "typescript/javascript", "cjs": "typescript/javascript", "python": "python", "go": "go", "rust": "rust", "java": "java", "csharp": "csharp",
}
EXTENSION = {
    ".ts": "typescript", ".tsx": "tsx", ".mjs": "mjs", ".cjs": "cjs", ".jsx": "jsx", ".js": "javascript",
    ".py": "python", ".go": "go", ".rs": "rust", ".java": "java", ".cs": "csharp",
}


def crosses_family(a: Column, b: Column) -> Column:
    fa, fb = looked_up(FAMILY, a), looked_up(FAMILY, b)
    return F.coalesce(fa != fb, F.lit(False))


def language_of(path: Column) -> Column:
    return looked_up(EXTENSION, F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)))


def nearest_rank(values: Column, p: float) -> Column:
    """Of an array: the value at floor(n * p) of the sorted values, clamped."""
    at = F.least(F.floor(F.size(values) * F.lit(p)), F.size(values) - 1)
    return F.element_at(F.sort_array(values), (at + 1).cast("int"))


def redacted_error(text: Column) -> Column:
    """A message without what tells one machine from another: paths, then unique ids, then long hexadecimal numbers, then numbers."""
    # What goes, and its mark.
    marks = [
        (r"[A-Za-z]:[\\/]\S+|/(?:[^\s/]+/)+\S*", "<path>"),
        (r"(?i)[0-9a-f]{8}-[0-9a-f-]{27,}", "<uuid>"),
        (r"(?i)\b(?:0x)?[0-9a-f]{8,}\b", "<id>"),
        (r"\b[0-9]+(?:\.[0-9]+){0,3}\b", "<n>"),
        (r"\s+", " "),
    ]
    for pattern, mark in marks:
        text = F.regexp_replace(text, pattern, mark)
    return F.trim(text)


# Which kinds of relation an intent shows; any other intent shows all.
INTENTS = {"architecture": ["CONTAINS", "IMPORTS", "EXTENDS", "IMPLEMENTS", "EXPORTS"], "debugging": ["CALLS", "REFERENCES", "IMPORTS"]}


def in_intent(intent: Column, kind: Column) -> Column:
    shown = F.lit(True)
    for name, kinds in INTENTS.items():
        shown = F.when(intent == name, kind.isin(kinds)).otherwise(shown)
    return shown


def lexical_score(exact: Column, qualified: Column, bm25: Column) -> Column:
    """1 for the name itself, 0.95 for the qualified name, else what falls as BM25 grows."""
    return F.when(exact, 1.0).when(qualified, 0.95).otherwise(1 / (1 + F.abs(bm25)))


def utf16_units(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return F.length(F.encode(text, "UTF-16BE")) / 2


def within_folder(path: Column, folder: str) -> Column:
    """Whether a path is ``folder`` or lies in it."""
    root = folder.rstrip("/")
    return (path == root) | path.startswith(root + "/")
