"""Text expressions: signatures, markup, search scores, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_of_signature(signature: Column) -> Column:
    """Function name of a C signature: the last word before the first parenthesis, without stars; else null."""
    before = F.trim(F.substring_index(F.trim(signature), "(", 1))
    name = F.regexp_replace(F.element_at(F.split(before, r"\s+"), -1), r"^\*+", "")
    return F.when(F.contains(signature, F.lit("(")), F.nullif(name, F.lit("")))


def text_of_markup(kind: Column, value: Column) -> Column:
    """Plaintext as it is; of markdown the name in its first signature line, else its first line of text, else all."""
    lines = F.split(value, "\n")
    plain = lambda l: ~F.startswith(F.trim(l), F.lit("#"))
    signature = F.get(F.filter(lines, lambda l: F.contains(l, F.lit("(")) & F.contains(l, F.lit(")")) & plain(l)), 0)
    first = F.get(F.filter(F.transform(lines, F.trim), lambda l: (l != "") & plain(l)), 0)
    return F.when(kind == "plaintext", value).otherwise(F.coalesce(name_of_signature(signature), first, value))


def text_of_marked(language: Column, value: Column) -> Column:
    """A marked string: without a language as it is, else the name of its signature or all of it."""
    return F.when(language.isNull(), value).otherwise(F.coalesce(name_of_signature(value), value))


def hover_text(parts: Column) -> Column:
    """Texts of a hover answer joined by newlines; nothing if empty."""
    return F.nullif(F.array_join(parts, "\n"), F.lit(""))


def hover_of(result: Column) -> Column:
    """The text of a hover answer, a JSON text: a marked string, several of them or marked-up text; null without one."""
    contents = F.try_variant_get(F.try_parse_json(result), "$.contents", "variant")
    field = lambda v, name: F.try_variant_get(v, f"$.{name}", "string")
    is_text = lambda v: F.schema_of_variant(v) == "STRING"
    marked = lambda v: F.when(is_text(v), F.try_variant_get(v, "$", "string")).otherwise(text_of_marked(field(v, "language"), field(v, "value")))
    several = F.try_variant_get(contents, "$", "array<variant>")
    one = F.when(field(contents, "kind").isNotNull(), text_of_markup(field(contents, "kind"), field(contents, "value"))).otherwise(marked(contents))
    return hover_text(F.when(several.isNotNull(), F.transform(several, marked)).otherwise(F.array(one)))


def phase_text(phase: Column, done: Column, total: Column, reason: Column) -> Column:
    """What the status line says about a phase of loading."""
    # Phases and their texts.
    said = {
        "NotStarted": "not started", "SpawningServer": "starting clangd…", "Initializing": "initializing…", "Initialized": "initialized",
        "DiscoveringFiles": "discovering project files…", "Completed": "ready",
    }
    out = F.when(phase == "PreloadingDocuments", F.format_string("preloading documents… %d/%d", done, total))
    out = out.when(phase == "LoadingWorkspaceSymbols", F.format_string("loading workspace symbols… %d", done))
    out = out.when(phase == "Failed", F.concat(F.lit("failed ("), reason, F.lit(")")))
    for name, text in said.items():
        out = out.when(phase == name, text)
    return F.concat(F.lit("LSP: "), out)


def fuzzy_score(pattern: Column, text: Column) -> Column:
    """Score of the pattern as a left-most subsequence of the text, both lower-cased; null if it is none.

    Share of the pattern's bytes that match, by the logarithm of where the match begins, by its span.
    """
    p, t = F.lower(pattern), F.lower(text)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(-1).alias("first"), F.lit(True).alias("ok"))

    def step(acc: Column, c: Column) -> Column:
        found = F.position(c, t, acc["at"] + 1)
        hit = acc["ok"] & (found > 0)
        return F.struct(
            F.when(hit, found).otherwise(acc["at"]).alias("at"), (acc["n"] + hit.cast("int")).alias("n"),
            F.when(hit & (acc["first"] < 0), found - 1).otherwise(acc["first"]).alias("first"), hit.alias("ok"))

    def score(acc: Column) -> Column:
        share = acc["n"].cast("double") / F.octet_length(p)
        early = F.lit(1.0) / F.greatest(F.log2(acc["first"].cast("double") + 1), F.lit(1.0))
        span = F.lit(1.0) / (acc["at"] - 1 - acc["first"] + 1).cast("double")
        return F.when(acc["ok"] & (acc["n"] > 0), share * early * span)

    return F.aggregate(F.array_remove(F.split(p, ""), ""), start, step, score)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def shortened(text: Column, most: int, left: int, mark: str) -> Column:
    """The text, or its first `left` characters and a mark if it has more than `most`."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, left), F.lit(mark))).otherwise(text)


def node_label(text: Column) -> Column:
    return shortened(text, 22, 21, "…")


def tab_label(text: Column) -> Column:
    return shortened(text, 15, 12, "...")


def workspace_label(text: Column) -> Column:
    return shortened(text, 20, 17, "...")
