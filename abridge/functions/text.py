"""Prompt templates (request side) and response parsers (completion side).

Templates render one request column; parsers are regex columns over the
``completions`` table, evaluated in bulk on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from abridge.functions.metrics import WS_CHARS
from abridge.functions.tokens import _c

# Request templates. Placeholders in braces are filled per row.
TMPL_ZERO_SHOT = ("Compress the following text into {target} tokens, as such you can still understand the "
                  "original meaning of it. {instruction}\n\nOriginal Text: {text}\nCompressed Text:")
TMPL_FEW_SHOT = ("Follow the demonstrations to compress the original text in {target} tokens. {instruction}"
                 "\n\n{examples}\n\nOriginal text: {text}\nCompressed text:")
TMPL_EXAMPLE = "Original text: {original}\nCompressed text: {compressed}\n-----"
TMPL_RECONSTRUCT = ("Please reconstruct the original text from this compressed version:\n\n"
                    "Compressed text: {compressed}\n\nReconstructed text:")
TMPL_QA = ("Answer the following question based on the given context:\n\n"
           "                Context: {compressed}\n                Question: {question}\n                Answer:")
TMPL_REASON = "{compressed}\n\n        Question: {question}\n        Answer:"
TMPL_VANILLA = ("Please compress the following text to approximately {target} tokens while preserving the "
                "most important information:\n\nText: {text}\n\nCompressed:")
TMPL_LINGUA_TARGET = ("Compress the following text while preserving key information:\n\n"
                      "        Text: {text}\n\n        Compressed (around {target} tokens):")
TMPL_LINGUA_PLAIN = ("Compress the following text while preserving key information:\n\n"
                     "                                        Original Text: {text}\n"
                     "                                        Compressed Text:")

# Response patterns (Java regex flags; group 1 is the payload).
_TAIL = r"(.*?)(?:\n\n|\n$|$)"
COMPRESSION_PATTERNS = [r"(?isd)Compressed Text:\s*" + _TAIL, r"(?isd)Compressed:\s*" + _TAIL,
                        r"(?isd)Output:\s*" + _TAIL]
RECONSTRUCTION_PATTERNS = [r"(?isd)Reconstructed text:\s*(.*)", r"(?isd)Reconstructed:\s*(.*)",
                           r"(?isd)Original text:\s*(.*)"]
VANILLA_PATTERNS = [r"(?sd)Compressed:\s*" + _TAIL, r"(?sd)Output:\s*" + _TAIL]
VANILLA_LEAD_IN = r"(?isd)^(Here's|The compressed|I've compressed|This is|The).*?:"
LINGUA_PATTERNS = [r"(?sd)Compressed \(.*?\):\s*" + _TAIL, r"(?sd)Compressed:\s*" + _TAIL]
CLEAN_LEAD_IN = r"(?id)(Let me|I will|Here's|This is|To compress).*?:"
# What ``(?U)\\s`` matches.
UNICODE_WS = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
CLEAN_NOTES = [r"(?i)Example:[^\n]*", r"(?i)Explanation:[^\n]*", r"(?i)Note:[^\n]*"]


def render(template: str, **cols) -> Column:
    """Fill ``{name}`` placeholders of ``template`` with columns (as strings)."""
    parts = []
    rest = template
    while "{" in rest:
        pre, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        if pre:
            parts.append(F.lit(pre))
        parts.append(_c(cols[name]).cast("string"))
    if rest:
        parts.append(F.lit(rest))
    return F.concat(*parts)


def examples_block(demos) -> Column:
    """``tmpl_few_shot`` demonstrations: array<struct<original, compressed>> -> text block."""
    return F.array_join(F.transform(_c(demos), lambda d: render(TMPL_EXAMPLE, original=d["original"],
                                                                compressed=d["compressed"])), "\n")


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def py_strip(x) -> Column:
    """Python ``str.strip()`` (Unicode whitespace): looks at the ends alone."""
    return F.trim(_c(x), F.lit(UNICODE_WS))


def first_match(text, patterns, default) -> Column:
    """Group 1 of the first pattern that matches, else ``default``; a final line break may be left for the caller to strip.

    A pattern is a label, white space, and a payload that always matches, so each text is searched once, for the label; the
    payload is cut out without a regex.
    """
    t, out = _c(text), default
    for p in reversed(patterns):
        label, tail = p.split(r"\s*", 1)
        out = let(F.split(t, label, 2), _payload_or(out, tail == _TAIL))
    return out


def _payload_or(other, first_block: bool):
    def use(parts):
        payload = F.ltrim(F.get(parts, F.lit(1)), F.lit(WS_CHARS))
        return F.when(F.size(parts) == 2, F.substring_index(payload, "\n\n", 1) if first_block else payload).otherwise(other)
    return use


def clean_compression(x) -> Column:
    """``clean_compression``: drop lead-ins and Example/Explanation/Note lines, collapse whitespace."""
    c = F.regexp_replace(_c(x), CLEAN_LEAD_IN, "")
    for p in CLEAN_NOTES:
        c = F.regexp_replace(c, p, "")
    return py_strip(F.regexp_replace(c, r"(?U)\s+", " "))


def parse_compression(response) -> Column:
    """``parse_compression``: labelled payload (or the whole text), then cleaned."""
    r = _c(response)
    return clean_compression(py_strip(first_match(r, COMPRESSION_PATTERNS, py_strip(r))))


def parse_reconstruction(response) -> Column:
    r = _c(response)
    return py_strip(first_match(r, RECONSTRUCTION_PATTERNS, r))


def parse_vanilla(response) -> Column:
    body = py_strip(let(py_strip(response), lambda r: first_match(r, VANILLA_PATTERNS, r)))
    return py_strip(F.regexp_replace(body, VANILLA_LEAD_IN, ""))


def parse_lingua(response) -> Column:
    return py_strip(let(py_strip(response), lambda r: first_match(r, LINGUA_PATTERNS, r)))
