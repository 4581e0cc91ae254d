"""Text expressions: token budgets, keywords, fact extraction, intent, rendering. All native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no signal when procedures are looked up.
STOP_WORDS = (
    "what when where have been that this with from they their does done will would could should there these those also just each some "
    "more than into over then them most your come after before used look like issue issues past last next first since actually specific "
    "which upon about such being given while"
).split()
# What is trimmed from words, and how many keywords of what length there are.
KEYWORD_TRIM = "?.!,;:'\"()"
LEAST_KEYWORD, MOST_KEYWORDS = 4, 8

# Verb groups of simple statements, in order of precedence, with the predicate each stands for.
STATEMENT_VERBS = (("prefers?|likes?", "prefers"), ("uses?|utilizes?", "uses"), ("is|are|was", "is"), ("has|have|had", "has"), ("requires?|needs?", "requires"), ("avoids?|never", "avoids"))

# Words that hint at a store.
INTENT_HINTS = {
    "episodic": "remember|recall|last time|yesterday|happened|did|said|told|saw|ago|recent|history|log",
    "semantic": "know|fact|true|is|are|what is|define|relationship|between|how does|who is",
    "procedural": "how to|steps|procedure|workflow|process|deploy|run|execute|do I|should I",
}
# Words of questions and of negation.
QUESTION_WORDS = "what|how|why|when|where|who|which"
NEGATIONS = "not|never|no|cannot|can't|don't|doesn't|isn't|aren't"
#: Unicode-aware, and blind to case, in the manner of most regular expression engines but Java's.
UNICODE = "(?iuU)"


def count_tokens(text: Column) -> Column:
    """Approximate tokens: a quarter of the characters, one at least. (A BPE count is an Arrow UDF of the caller's.)"""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("bigint")


def truncate_to_budget(text: Column, budget: Column) -> Column:
    """Empty for no budget; the text where it fits; else its first 4 b - 3 characters and an ellipsis."""
    cut = F.concat(F.substring(text, F.lit(1), (budget * 4 - 3).cast("int")), F.lit("..."))
    return F.when(budget <= 0, F.lit("")).when(count_tokens(text) <= budget, text).otherwise(cut)


def fits_budget(text: Column, budget: Column) -> Column:
    return count_tokens(text) <= budget


def white_split(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def keywords(text: Column) -> Column:
    """Up to eight distinct words that may tell one procedure from another, in order."""
    bare = F.transform(white_split(text), lambda w: F.lower(F.regexp_replace(w, r"^[?.!,;:'\"()]+|[?.!,;:'\"()]+$", "")))
    kept = F.filter(bare, lambda w: (F.length(w) >= LEAST_KEYWORD) & ~w.isin(STOP_WORDS))
    return F.slice(F.array_distinct(kept), F.lit(1), F.lit(MOST_KEYWORDS))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """Trimmed sentences of five characters or more."""
    return F.filter(F.transform(F.split(text, r"[.!?\n]+"), trimmed), lambda s: F.length(s) >= 5)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def statement(sentence: Column) -> Column:
    """(subject, predicate, object) of the first verb group that matches; null where none does or a part has an odd length.

    A sentence is searched for any verb between spaces first, which is cheap, then for each group's, and only then for the whole pattern.
    """
    none = F.lit(None).cast("struct<subject:string,predicate:string,object:string>")

    def whole(verbs: str, name: str) -> Column:
        pattern = UNICODE + rf"(\w[\w\s]{{1,30}}?)\s+({verbs})\s+(.+)"
        end = F.element_at(F.split(trimmed(F.regexp_extract(sentence, pattern, 3)), UNICODE + r"[,;]|\band\b|\bbut\b"), 1)
        found = _let(F.regexp_extract(sentence, pattern, 1), lambda s: F.when(s != "", F.struct(trimmed(s).alias("subject"), F.lit(name).alias("predicate"), trimmed(end).alias("object"))))
        return F.when(F.regexp_like(sentence, F.lit(UNICODE + rf"\s({verbs})\s")), found).otherwise(none)

    every = "|".join(v for v, _ in STATEMENT_VERBS)
    first = F.when(F.regexp_like(sentence, F.lit(UNICODE + rf"\s({every})\s")), F.coalesce(*(whole(v, n) for v, n in STATEMENT_VERBS)))
    return _let(first, lambda x: F.when(F.length(x.subject).between(2, 50) & F.length(x.object).between(2, 80), x))


def intent_hits(text: Column, store: str) -> Column:
    return F.regexp_count(text, F.lit(rf"(?i)\b({INTENT_HINTS[store]})\b")).cast("bigint")


def capitalised_words(text: Column) -> Column:
    """Up to ten words after the first that begin with a capital and are not all capitals, without punctuation around."""
    w = white_split(text)
    rest = F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1)))
    some = F.filter(rest, lambda x: F.regexp_like(x, F.lit(r"^\p{Lu}")) & F.regexp_like(x, F.lit(r"\p{Ll}")) & (F.length(x) > 1))
    return F.slice(F.transform(some, lambda x: F.regexp_replace(x, "^[.,!?;:\"']+|[.,!?;:\"']+$", "")), F.lit(1), F.lit(10))


def has_question(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"(?U)\?\s*$")) | F.regexp_like(text, F.lit(UNICODE + rf"\b({QUESTION_WORDS})\b"))


def has_negation(text: Column) -> Column:
    return F.regexp_like(text, F.lit(UNICODE + rf"\b({NEGATIONS})\b"))


def text_metadata(text: Column) -> Column:
    return F.struct(
        count_tokens(text).alias("token_count"), F.size(white_split(text)).cast("bigint").alias("word_count"), capitalised_words(text).alias("entities"), has_question(text).alias("has_question"), has_negation(text).alias("has_negation")
    )


def fact_text(subject: Column, predicate: Column, object_: Column) -> Column:
    return F.concat_ws(" ", subject, predicate, object_)


def procedure_text(name: Column, description: Column, steps: Column) -> Column:
    """One line: name, description, steps with their tools."""
    one = F.transform(steps, lambda s: F.when(s.tool.isNotNull() & (s.tool != ""), F.concat(s.action, F.lit(" ("), s.tool, F.lit(")"))).otherwise(s.action))
    return F.concat(F.lit("Procedure '"), name, F.lit("': "), description, F.lit(". Steps: "), F.array_join(one, " → "))


def item_id(agent: Column, namespace: Column, key: Column) -> Column:
    """A UUID of version 5 shape that agent, namespace and key decide."""
    h = F.sha1(F.concat_ws("/", agent, F.array_join(namespace, "/"), key).cast("binary"))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def like_everywhere(query: Column, *columns: Column) -> Column:
    """Whether any column holds the query (ASCII letters of either case; % and _ in it stay wildcards)."""
    pattern = F.concat(F.lit("%"), F.replace(query, F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.call_function("like", F.lower(c), F.lower(pattern)), F.lit(False))
    return found
