"""Token analysis in SQL functions: scripts, parts of speech, lexemes, and the class of a token."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of speech of function words.
FUNCTION_POS = ("CONJ", "INTJ", "PART", "PR")
LONG = 15
# Phrases counted per sample.
TWO_GRAMS = [("высокий", "качество"), ("более", "чем"), ("страна", "мир"), ("низкий", "стоймость"), ("первый", "место")]
THREE_GRAMS = [("один", "из", "хороший"), ("один", "из", "самый")]


@dataclass(frozen=True)
class Script:
    """Which letters are the target language's and which are foreign; the lexeme's letters, with or without those beyond the base range."""

    own: str = "[а-яёА-ЯЁ]"
    foreign: str = "[a-zA-Z]"
    lexeme: str = "[а-яё]"
    short_lexeme: str = "[a-zа-я]"
    gerund: str = "ние"
    superlative: str = ",прев"
    persons: tuple[str, ...] = ("1-л", "2-л")


CYRILLIC = Script()
#: For text in Latin letters: all words are the target's, none foreign.
LATIN = Script(own=r"\p{L}", foreign=r"[^\p{L}\p{N}\s]", lexeme=r"\p{Ll}", short_lexeme="[a-z]", gerund="ing")


def form_of(line: Column) -> Column:
    """What stands before the first brace; a line without one is malformed."""
    return F.when(F.instr(line, "{") > 0, F.regexp_extract(line, r"(?s)^([^{]*)\{", 1)).otherwise(F.raise_error(F.concat(F.lit("no analysis: "), line)))


def info_of(line: Column) -> Column:
    return F.regexp_extract(line, r"(?s)^[^{]*\{(.*?)\}?$", 1)


def pos_of(info: Column) -> Column:
    """The capitals after the first equals sign; null if the analysis has none."""
    return F.when(F.instr(info, "=") > 0, F.regexp_extract(info, "^[^=]*=([A-Z]+)", 1))


def lexeme_of(info: Column, script: Script = CYRILLIC) -> Column:
    return F.regexp_extract(info, f"^({script.lexeme}*)", 1)


def short_lexeme_of(info: Column, script: Script = CYRILLIC) -> Column:
    """The lexeme as the vector tools cut it: the first character whatever it is, then letters of the base range."""
    return F.regexp_extract(info, f"(?s)^(.{script.short_lexeme}*)", 1)


def symbol(form: Column, info: Column, script: Script = CYRILLIC, pos: Column | None = None, lexeme: Column | None = None) -> Column:
    """What a token is in its sample's sequence: the form, the lexeme, or * for what isn't the target's language.

    pos, lexeme: columns that hold them already."""
    pos = pos_of(info) if pos is None else pos
    lexeme = lexeme_of(info, script) if lexeme is None else lexeme
    return F.when(~form.rlike(script.own), "*").when(pos.isNull() & ~form.rlike(script.foreign), form).when(pos.isNull(), "*").when(pos.isin(*FUNCTION_POS), form).otherwise(lexeme)


def marks(form: Column, info: Column, script: Script = CYRILLIC) -> Column:
    """array<string>: the features that a token adds one to; those with % in their name are shares later on."""
    pos, lexeme = pos_of(info), lexeme_of(info, script)
    return F.filter(F.array(*mark_list(form, info, script, pos, lexeme, form.rlike(script.own), ~pos.isin(*FUNCTION_POS))), lambda x: x.isNotNull())


def mark_list(form: Column, info: Column, script: Script, pos: Column, lexeme: Column, own: Column, content: Column) -> list[Column]:
    """What marks() gives, each feature in its own column, null where the token hasn't it.

    pos, lexeme; own: whether a letter of the target's language is in it; content: whether it is no function word. As columns that a
    row holds already, they are worked out once for all features."""
    person = F.lit(False)
    for p in script.persons:
        person = person | F.contains(info, F.lit(p))
    named = [
        (~own, F.lit("non russian%")),
        (own & pos.isNull() & form.rlike(script.foreign), F.lit("unknown%")),
        (own & pos.isNotNull(), F.concat(F.lit("POS%-"), pos)),
        (own & content & (F.length(lexeme) > 3) & lexeme.endswith(script.gerund), F.lit("отглагольное_существительное%")),
        (own & content & (F.length(lexeme) >= LONG), F.lit("длинное_слово%")),
        (own & content & F.contains(info, F.lit(script.superlative)), F.lit("превосходное_прилагательное%")),
        (own & content & person, F.lit("1,2-е_лицо%")),
        (own & content, F.concat(F.lit("1gram-"), lexeme)),
    ]
    return [F.when(c, n) for c, n in named]


def rule_analysis(form: Column) -> Column:
    """The built-in analysis of a word in place of an external analyser: lexeme=POS by ending.

    It is this library's own convention; endings are of Latin-script languages.
    """
    low = F.lower(form)
    pos = F.when(F.length(low) <= 2, "PR").when(low.isin("and", "und", "the", "der", "die", "que", "les", "los"), "CONJ").when(low.rlike("(ing|ung|ment|tion|ción|heit|keit)$"), "S").when(low.rlike("(ly|ment|mente|lich)$"), "ADV").otherwise("A")
    return F.concat(low, F.lit("="), pos, F.when(low.endswith("est"), ",прев").otherwise(""))


def batch_marks(form: pa.Array, info: pa.Array, script: Script = CYRILLIC) -> tuple[list[tuple[pa.Array, pa.Array]], pa.Array]:
    """What mark_list() and symbol() give, for the different words of a block at once: (places of the words, names) of each feature, and the symbols."""
    low, has, empty = (lambda x: pc.fill_null(x, "")), pc.match_substring_regex, pa.scalar("")
    own, foreign, known = has(form, script.own), has(form, script.foreign), pc.match_substring(info, "=")
    pos = low(pc.struct_field(pc.extract_regex(info, "^(?s:[^=]*)=(?P<x>[A-Z]+)"), "x"))
    lexeme = low(pc.struct_field(pc.extract_regex(info, f"^(?P<x>{script.lexeme}*)"), "x"))
    content = pc.and_(known, pc.invert(pc.is_in(pos, pa.array(FUNCTION_POS))))
    told, n, person = pc.and_(own, content), pc.utf8_length(lexeme), pa.scalar(False)
    for x in script.persons:
        person = pc.or_(person, pc.match_substring(info, x))
    named = [
        (pc.invert(own), "non russian%"),
        (pc.and_(pc.and_(own, pc.invert(known)), foreign), "unknown%"),
        (pc.and_(own, known), pc.binary_join_element_wise("POS%-", pos, empty)),
        (pc.and_(pc.and_(told, pc.greater(n, 3)), pc.ends_with(lexeme, script.gerund)), "отглагольное_существительное%"),
        (pc.and_(told, pc.greater_equal(n, LONG)), "длинное_слово%"),
        (pc.and_(told, pc.match_substring(info, script.superlative)), "превосходное_прилагательное%"),
        (pc.and_(told, person), "1,2-е_лицо%"),
        (told, pc.binary_join_element_wise("1gram-", lexeme, empty)),
    ]
    found = []
    for c, name in named:
        at = pc.indices_nonzero(c)
        found.append((at, pa.repeat(name, len(at)) if isinstance(name, str) else name.take(at)))
    # the form, the lexeme, or * for what isn't the target's language
    as_form = pc.and_(own, pc.if_else(known, pc.invert(content), pc.invert(foreign)))
    return found, pc.if_else(as_form, form, pc.if_else(told, lexeme, "*"))
