"""Inline LaTeX as plain Unicode, where every part of a formula has a character of its own."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Macros and the characters they stand for. Greek letters follow from their Unicode names.
GREEK = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
VARIANTS = {"varepsilon": "ε", "vartheta": "ϑ", "varpi": "ϖ", "varrho": "ϱ", "varsigma": "ς", "varphi": "ϕ", "lambda": "λ", "Lambda": "Λ"}
SYMBOLS = {
    "approx": "≈", "sim": "∼", "simeq": "≃", "cong": "≅", "equiv": "≡", "propto": "∝", "times": "×", "cdot": "·", "div": "÷", "ast": "∗", "pm": "±", "mp": "∓",
    "leq": "≤", "le": "≤", "geq": "≥", "ge": "≥", "neq": "≠", "ne": "≠", "ll": "≪", "gg": "≫", "in": "∈", "notin": "∉", "ni": "∋", "subset": "⊂", "supset": "⊃",
    "subseteq": "⊆", "supseteq": "⊇", "cup": "∪", "cap": "∩", "emptyset": "∅", "to": "→", "rightarrow": "→", "leftarrow": "←", "Rightarrow": "⇒", "Leftarrow": "⇐",
    "leftrightarrow": "↔", "Leftrightarrow": "⇔", "uparrow": "↑", "downarrow": "↓", "mapsto": "↦", "langle": "⟨", "rangle": "⟩", "lceil": "⌈", "rceil": "⌉",
    "lfloor": "⌊", "rfloor": "⌋", "cdots": "⋯", "ldots": "…", "dots": "…", "vdots": "⋮", "forall": "∀", "exists": "∃", "neg": "¬", "wedge": "∧", "vee": "∨",
    "partial": "∂", "nabla": "∇", "infty": "∞", "sum": "∑", "prod": "∏", "int": "∫", "sqrt": "√", "circ": "∘", "degree": "°",
    "quad": "  ", "qquad": "    ", "left": "", "right": "", "displaystyle": "", "textstyle": "", "scriptstyle": ""}
ESCAPES = {"%": "%", "&": "&", "#": "#", "$": "$", "_": "_", "{": "{", "}": "}", ",": " ", ";": " ", ":": " ", "!": "", " ": " "}
FONTS = ("mathrm", "mathbf", "mathit", "mathsf", "mathtt", "mathsc", "mathbb", "mathcal", "boldsymbol")
TEXT_COMMANDS = ("underline", "text", "textrm", "texttt", "textsf", "textbf")


@lru_cache(1)
def macros() -> dict[str, str]:
    small = {n: unicodedata.lookup(f"GREEK SMALL LETTER {n.upper()}") for n in GREEK}
    large = {n.capitalize(): unicodedata.lookup(f"GREEK CAPITAL LETTER {n.upper()}") for n in ("gamma", "delta", "theta", "xi", "pi", "sigma", "upsilon", "phi", "psi", "omega")}
    return small | large | VARIANTS | SYMBOLS


@lru_cache(2)
def scripts(kind: str) -> dict[str, str]:
    """Characters with a raised (<super>) or lowered (<sub>) form, by the decompositions that Unicode tells; the first form wins."""
    out: dict[str, str] = {}
    for code in range(sys.maxunicode + 1):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and parts[0] == kind and not unicodedata.name(chr(code), "").startswith(("MODIFIER LETTER CYRILLIC", "FEMININE", "MASCULINE")):
            out.setdefault(chr(int(parts[1], 16)), chr(code))
    out["-"] = out.get("\u2212", "")
    return out | ({".": "·", ",": "˒"} if kind == "<super>" else {})


@lru_cache(2)
def _forms(kind: str) -> dict[str, str]:
    return scripts(kind) | {" ": " "}


def _script(text: str, kind: str) -> str | None:
    table = _forms(kind)
    return "".join(table[c] for c in text) if all(table.get(c) for c in text) else None


def resolved(inner: str) -> str | None:
    """A formula's text in Unicode, None if a part of it has no plain form."""
    if not re.search(r"[\\{}^_]", inner):
        return inner
    for font in FONTS:
        for _ in range(3):
            inner = re.sub(rf"\\{font}\{{([^{{}}]+)\}}", r"\1", inner)
    inner = re.sub(r"\\([A-Za-z]+)", lambda m: _macro(m.group(1), m.group(0)), inner)
    inner = re.sub(r"\\([^A-Za-z])", lambda m: {"{": "\ue000", "}": "\ue001", "_": "\ue002"}.get(m.group(1), ESCAPES.get(m.group(1), m.group(0))), inner)
    for mark, kind in (("\\^", "<super>"), ("_", "<sub>")):
        inner = re.sub(mark + r"\{([^{}^_]+)\}", lambda m, k=kind: _script(m.group(1), k) or m.group(0), inner)
    for mark, kind in (("\\^", "<super>"), ("_", "<sub>")):
        inner = re.sub(mark + r"([^\s{}^_\\])", lambda m, k=kind: _script(m.group(1), k) or m.group(0), inner)
    inner = re.sub(r"\{\s*\}", "", inner)
    # Escaped braces and underscores are residues too: a formula that shows them is left to the formula renderer.
    return None if re.search(r"[\\{}^_\ue000-\ue002]", inner) else inner


def _macro(name: str, whole: str) -> str:
    return macros().get(name, whole)


def simplified(text: str) -> str:
    """Inline formulas replaced by plain text where that is possible; others are trimmed and stay."""
    def one(m: re.Match) -> str:
        inner = m.group(1).strip()
        if plain := re.match(rf"^\\(?:{'|'.join(TEXT_COMMANDS)})\{{((?:[^{{}}]|\{{[^{{}}]*\}})+)\}}$", inner):
            return re.sub(r"\\text\{([^{}]+)\}", r"\1", plain.group(1))
        if (bare := re.match(r"^\{\}\s*\^\{([^{}]+)\}$", inner)) and (raised := _script(bare.group(1), "<super>")):
            return raised
        found = resolved(inner)
        return found if found is not None else f"${inner}$"

    return re.sub(r"\$([^$\n]+)\$", one, text)


@F.pandas_udf(StringType())
def _simplified(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else simplified(t))


def simplify_inline(c: Column) -> Column:
    """simplified for a column; texts without a dollar sign never leave the JVM's result."""
    return F.when(F.contains(c, F.lit("$")), _simplified(c)).otherwise(c)
