"""Text functions: Column in, Column out, all in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicons import CLAUSE_BREAK, DEFAULT, GENERIC_PHRASES, QUESTION_WORDS, TITLE_CASE, TOKEN, Lexicon


def words_literal(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), 0)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def content_tokens(text: Column, lexicon: Lexicon = DEFAULT) -> Column:
    return F.filter(tokenize(text), lambda w: ~w.isin(lexicon.stopwords))


def normalize(text: Column, lexicon: Lexicon = DEFAULT) -> Column:
    return F.array_join(content_tokens(text, lexicon), " ")


def token_set(text: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """Distinct content tokens in order: computed once for each text, compared in every pair."""
    return F.array_sort(F.array_distinct(content_tokens(text, lexicon)))


def sentences(text: Column) -> Column:
    parts = F.split(strip(text), r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def locate_sentence(title: Column, text: Column, evidence: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """(sentence_index, sentence): the first of title (0) and sentences whose normal form holds that of the evidence or is held by it.

    A title without a content word is held by any. Without a match: 0 and the evidence, else the title.
    """
    parts = F.concat(F.array(F.coalesce(title, F.lit(""))), F.coalesce(sentences(text), F.array().cast("array<string>")))
    rows = F.transform(parts, lambda s, i: F.struct(i.alias("sentence_index"), s.alias("sentence"), normalize(s, lexicon).alias("norm")))
    none = F.struct(F.lit(0).alias("sentence_index"), F.coalesce(F.nullif(evidence, F.lit("")), title, F.lit("")).alias("sentence"))

    def found(norm: Column) -> Column:
        hit = F.get(F.filter(rows, lambda r: (norm != "") & (F.contains(r["norm"], norm) | F.contains(norm, r["norm"]))), 0)
        return let(hit, lambda h: F.when(h.isNotNull(), F.struct(h["sentence_index"].alias("sentence_index"), h["sentence"].alias("sentence"))).otherwise(none))

    return let(normalize(F.coalesce(evidence, F.lit("")), lexicon), found)


def display_trigger(trigger: Column, text: Column, most: int = 48) -> Column:
    """The trigger, or without one the text's part before its first semicolon."""
    told = F.left(F.trim(F.element_at(F.split(F.replace(text, F.lit("trigger="), F.lit("")), ";"), 1)), F.lit(most))
    return F.coalesce(F.nullif(F.trim(trigger), F.lit("")), told, F.lit(""))

def clauses(sentence: Column, shortest: int = 12) -> Column:
    parts = F.transform(F.split(sentence, CLAUSE_BREAK), lambda c: F.btrim(c, F.lit(" ,.-")))
    kept = F.filter(parts, lambda c: F.length(c) >= shortest)
    whole = F.btrim(sentence, F.lit(" ,.-"))
    return F.when(F.size(kept) > 0, kept).when(F.length(whole) > 0, F.array(whole)).otherwise(F.array().cast("array<string>"))


def titlecase_entities(text: Column, most: int = 6) -> Column:
    found = F.regexp_extract_all(text, F.lit(TITLE_CASE), F.lit(0))
    return F.slice(F.array_distinct(F.filter(found, lambda e: ~F.lower(e).isin(QUESTION_WORDS))), 1, most)


def compact(text: Column, most: int) -> Column:
    """White space collapsed, and cut to most characters with an ellipsis; most <= 0 cuts nothing."""
    short = collapse(text)
    if most <= 0:
        return short
    return F.when(F.length(short) <= most, short).otherwise(F.concat(F.rtrim(F.substring(short, 1, most - 3)), F.lit("...")))


def event_mention(trigger: Column, context: Column, most: int = 180) -> Column:
    return F.concat(F.lit("trigger="), collapse(trigger), F.lit("; mention="), compact(context, most))


def stem(word: Column) -> Column:
    """Suffix cut: the first of ing, ed, es, s that leaves enough."""
    out = word
    for suffix, longer_than in reversed([("ing", 5), ("ed", 4), ("es", 4), ("s", 3)]):
        fits = word.endswith(suffix) & (F.length(word) > longer_than)
        out = F.when(fits, F.left(word, F.length(word) - len(suffix))).otherwise(out)
    return out


def trigger(text: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """Stem of the first token in the verb lexicon (as it is or stemmed), else of the first in the noun lexicon; null if none."""
    pairs = F.transform(tokenize(text), lambda w: F.struct(w.alias("w"), stem(w).alias("s")))
    free = F.filter(pairs, lambda p: ~p.w.isin(lexicon.non_event) & ~p.s.isin(lexicon.non_event))

    def first(words: list[str]) -> Column:
        return F.get(F.filter(free, lambda p: p.w.isin(words) | p.s.isin(words)), 0)["s"]

    return F.coalesce(first(lexicon.verbs), first(lexicon.nouns))


def jaccard(left: Column, right: Column, both: Column | None = None) -> Column:
    """Of two arrays of distinct values; an empty side gives 0. both is the number of values that they share, where it is known."""
    both = F.size(F.array_intersect(left, right)) if both is None else both
    total = F.size(left) + F.size(right) - both
    return F.when((F.size(left) > 0) & (F.size(right) > 0), both / total).otherwise(F.lit(0.0))


def clause_score(query_tokens: Column, clause: Column, is_title: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """Overlap with the query plus bonuses for a trigger, an entity, an event word and a title, less one for length."""
    tokens = tokenize(clause)
    hints = lexicon.verbs + lexicon.nouns
    return (
        jaccard(query_tokens, token_set(clause, lexicon))
        + F.when(trigger(clause, lexicon).isNotNull(), 0.18).otherwise(0.0)
        + F.when(F.size(titlecase_entities(clause)) > 0, 0.10).otherwise(0.0)
        + F.when(F.exists(tokens, lambda w: w.isin(hints) | stem(w).isin(hints)), 0.18).otherwise(0.0)
        + F.when(is_title, 0.15).otherwise(0.0)
        - F.when(F.size(tokens) > 26, 0.08).otherwise(0.0)
    )


def has_marker(text: Column, markers: list[str]) -> Column:
    """Whether a marker occurs anywhere in the lower-cased text, inside words too."""
    return F.lower(text).rlike("|".join(markers))


def hints(text: Column, words: list[str]) -> Column:
    """Whether a stem of the text is among words; of two texts together either one's counts, as relation() has it, unless a text is null."""
    return F.arrays_overlap(F.transform(tokenize(text), stem), words_literal(words))


def relation(source_text: Column, target_text: Column, lexicon: Lexicon = DEFAULT) -> Column:
    stems = F.transform(F.concat(tokenize(source_text), tokenize(target_text)), stem)
    return (
        F.when(F.arrays_overlap(stems, words_literal(lexicon.mitigation)), "mitigates")
        .when(F.arrays_overlap(stems, words_literal(lexicon.escalation)), "escalates")
        .when(has_marker(F.concat_ws(" ", source_text, target_text), lexicon.markers), "causes")
        .otherwise("precedes")
    )


def clean_document(title: Column, text: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """Lines that say something new: not blank, not the title, not a repeat, no by-line and no source line.

    Repeats are found by sorting: the first of each normal form stays, and the lines go back to their order.
    """
    title_norm = normalize(F.coalesce(title, F.lit("")), lexicon)
    lines = F.transform(F.split(text, "\n"), lambda x, i: let(collapse(x), lambda line: F.struct(normalize(line, lexicon).alias("norm"), i.alias("i"), line.alias("line"))))

    def told(x: Column) -> Column:
        low = F.lower(x["line"])
        return (x["norm"] != "") & (x["norm"] != title_norm) & ~(low.startswith("by ") & (F.size(F.split(x["line"], " ")) <= 8)) & ~low.startswith("source:")

    def first(rows: Column) -> Column:
        new = F.filter(rows, lambda x, k: (k == 0) | (F.get(rows, k - 1)["norm"] != x["norm"]))
        return F.array_sort(F.transform(new, lambda x: F.struct(x["i"].alias("i"), x["line"].alias("line"))))

    return F.array_join(F.transform(let(F.array_sort(F.filter(lines, told)), first), lambda x: x["line"]), "\n")


def is_generic(text: Column) -> Column:
    words = collapse(F.lower(text))
    n = F.size(F.split(words, " "))
    phrase = words.rlike("|".join(GENERIC_PHRASES))
    return (words == "") | phrase | (n < 3) | (n > 32)


def relative_time_score(value: Column) -> Column:
    v = F.regexp_replace(F.lower(F.trim(value)), " ", "")
    back = F.regexp_extract(v, r"^t-(\d+)$", 1)
    return (
        F.when(v.isNull() | (v == ""), 0.0)
        .when(v.isin("beforet", "pre-t", "pret"), 0.8)
        .when(back != "", F.when(back.rlike("[1-9]"), 1.0).otherwise(0.0))
        .when(v.rlike(r"^t\+\d+$"), 0.0)
        .when(v.contains("before") | v.contains("prior"), 0.6)
        .otherwise(0.0)
    )
