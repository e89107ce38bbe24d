"""The text kernel as Column expressions: cleaning, signals, gates, signatures, language and rule labels."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed


def bound(c: Column, f) -> Column:  # noqa: ANN001
    """``f(c)`` with ``c`` made once, however often and from whatever lambda ``f`` refers to it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strip(c: Column) -> Column:
    """White space off both ends, Unicode's included."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def clean(text: Column) -> Column:
    """Lower case; URLs and tags out; all but letters and marks to single spaces. Null gives the empty text.

    Number signs that are no digits also become spaces.
    """
    c = F.lower(F.coalesce(text, F.lit("")))
    for pattern, by in ((r"https?://\S+|www\.\S+", ""), (r"<.*?>", ""), (r"[^\p{L}\p{M}\p{Nl}\s]", " "), (r"(?U)\s+", " ")):
        c = F.regexp_replace(c, pattern, by)
    return F.trim(c)


def tokens(cleaned: Column) -> Column:
    """The words of a cleaned text."""
    return F.filter(F.split(cleaned, " "), lambda t: t != "")


def kept_words(text: Column) -> Column:
    """Cleaned words without stop words and single letters."""
    return F.filter(tokens(clean(text)), lambda t: (F.length(t) > 1) & ~t.isin(*fixed.STOP_WORDS))


def preprocess(text: Column, lemmas: dict[str, str] | None = None) -> Column:
    """:func:`kept_words` joined by spaces; words stand for their lemmas unless ``lemmas`` has others (for many, see operators.lemmas)."""
    kept = kept_words(text)
    if lemmas:
        known = F.create_map(*[F.lit(x) for pair in lemmas.items() for x in pair])
        kept = F.transform(kept, lambda t: F.coalesce(F.try_element_at(known, t), t))
    return F.array_join(kept, " ")


def words(text: Column) -> Column:
    """Runs other than white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda t: t != "")


def signal(text: Column, name: str) -> Column:
    """The highest score of the signal's patterns that the text holds, 0 if none; rules in falling order of score."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    score = F.lit(0.0)
    for pattern, value in sorted(fixed.SIGNALS[name], key=lambda r: r[1]):
        score = F.when(lower.rlike(pattern), F.lit(value)).otherwise(score)
    return score


def signals(text: Column) -> Column:
    """All six signals as a struct, in fixed order."""
    return F.struct(*[signal(text, name).alias(name) for name in fixed.SIGNALS])


#: The shortest run of digits that no signal's pattern can name.
LONG_RUN = 1 + max(len(run) for rules in fixed.SIGNALS.values() for pattern, _ in rules for run in re.findall("[0-9]+", pattern))


def shape(text: Column) -> Column:
    """The text with its long runs of ASCII digits alike, empty for null: it has the words, the signals and the blankness of the text.

    Cleaning leaves no digits, and the signals' patterns name shorter runs only, each from its first digit and up to what is
    none (tested); so what follows from these can be made once for all texts of one shape.
    """
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[0-9]{%d,}" % LONG_RUN, "0" * LONG_RUN)


def explanation(values: Column, priority: Column) -> Column:
    """Why a priority: the phrases of the thresholds that signals reach, or a stock sentence."""
    parts = []
    for name, steps in fixed.REASONS:
        found = F.lit(None).cast("string")
        for threshold, phrase in reversed(steps):
            found = F.when(values[name] >= threshold, F.lit(phrase)).otherwise(found)
        parts.append(found)
    joined = F.lower(F.concat_ws(", ", *parts))
    stock = F.when(priority.isin("Low", "Medium"), F.lit(fixed.ROUTINE)).otherwise(F.lit(fixed.ELEVATED))
    told = F.concat(F.upper(F.substring(joined, 1, 1)), joined.substr(F.lit(2), F.length(joined)), F.lit(" detected."))
    return F.concat(priority, F.lit(" priority: "), F.when(joined == "", stock).otherwise(told))


def band(score: Column) -> Column:
    """How a score is shown."""
    return F.when(score >= 0.7, "danger").when(score >= 0.4, "warning").otherwise("normal")


def department(category: Column) -> Column:
    """The team of a category, trimmed; the general team for null and unknown ones."""
    teams = F.create_map(*[F.lit(x) for pair in fixed.DEPARTMENTS.items() for x in pair])
    return F.coalesce(F.try_element_at(teams, F.coalesce(strip(category), F.lit(""))), F.lit(fixed.DEFAULT_DEPARTMENT))


def gate(text: Column) -> Column:
    """struct(ticket_text, message, status_code): the trimmed text, or why it is turned away and how."""
    mash = lambda t: F.lower(t).isin(*fixed.KEYBOARD_MASHES)

    def vague(parts: Column) -> Column:
        repeated = F.exists(parts, lambda t: (F.length(t) >= 6) & (F.size(F.array_distinct(F.split(t, ""))) == 1))
        return repeated | (F.exists(parts, mash) & ~F.exists(parts, lambda t: t.rlike(r"^\p{L}+$") & ~mash(t)))

    def message(text: Column, trimmed: Column) -> Column:
        parts = F.filter(F.split(trimmed, r"[^\p{L}\p{N}]+"), lambda t: t != "")
        return (
            F.when(text.isNull(), fixed.GATE_EMPTY)
            .when(F.length(text) > fixed.MAX_TICKET_LENGTH, fixed.GATE_LONG)
            .when(trimmed == "", fixed.GATE_EMPTY)
            .when(~trimmed.rlike(r"\p{L}"), fixed.GATE_NO_WORDS)
            .when(bound(parts, vague), fixed.GATE_VAGUE)
        )

    # Text, trimmed text and message are made once a row; what refers to them would make each anew.
    told = lambda t: F.struct(t["trimmed"].alias("trimmed"), F.length(t["text"]).alias("n"), message(t["text"], t["trimmed"]).alias("message"))
    code = lambda t: F.when(t["n"] > fixed.MAX_TICKET_LENGTH, 413).otherwise(400)
    out = lambda t: F.struct(F.when(t["message"].isNull(), t["trimmed"]).alias("ticket_text"), t["message"].alias("message"), F.when(t["message"].isNotNull(), code(t)).alias("status_code"))
    trimmed = bound(text, lambda t: F.struct(t.alias("text"), strip(t).alias("trimmed")))
    return bound(bound(trimmed, told), out)


def pii(text: Column) -> Column:
    """The kinds of personal data a text holds, in fixed order."""
    return F.array_compact(F.array(*[F.when(text.rlike(pattern), F.lit(name)) for name, pattern in fixed.PII]))


def _masked(text: Column, masks: tuple[tuple[str, str], ...], noise: tuple[str, ...]) -> Column:
    c = F.trim(F.lower(F.coalesce(text, F.lit(""))))
    for pattern, by in masks:
        c = F.regexp_replace(c, pattern, by)
    c = F.trim(F.regexp_replace(c, r"\s+", " "))
    return reduce(lambda x, phrase: F.trim(F.replace(x, F.lit(phrase), F.lit(""))), noise, c)


def signature(text: Column) -> Column:
    """The template of a text: what varies masked, stock phrases out. Meant for texts of a ticket's size."""
    return _masked(text, fixed.MASKS, fixed.NOISE)


def audit_signature(text: Column) -> Column:
    """The audit's coarser template."""
    return _masked(text, fixed.AUDIT_MASKS, fixed.AUDIT_NOISE)


def _any_of(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def language_by_parts(text: Column) -> Column:
    """hinglish, gujarati or english by substrings, wherever they stand in a word."""
    lower = F.lower(text)
    return F.when(_any_of(lower, fixed.HINGLISH_PARTS), "hinglish").when(_any_of(lower, fixed.GUJARATI_PARTS), "gujarati").otherwise("english")


def language_by_words(text: Column) -> Column:
    """Devanagari script, a marker word of romanised Hindi, or else."""
    own = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda t: t.rlike("^[a-z]{2,}$"))
    marked = F.arrays_overlap(own, F.array(*map(F.lit, fixed.HINGLISH_WORDS)))
    return F.when(text.rlike("[ऀ-ॿ]"), "Hindi (Devanagari)").when(F.coalesce(marked, F.lit(False)), "Hinglish / Romanized Hindi").otherwise("English / Other")


def rule_priority(text: Column, base: Column, suffix: Column) -> Column:
    """A label by triggers in the text without its suffix; an urgent suffix lifts Low to Medium."""
    lower, end = F.lower(text), F.lower(suffix)
    main = F.when((end != "") & lower.endswith(end), F.trim(lower.substr(F.lit(1), F.length(lower) - F.length(end)))).otherwise(lower)
    settled = F.when(_any_of(main, fixed.LOW_TRIGGERS), "Low").otherwise(base)
    lifted = F.when(_any_of(end, fixed.URGENT_SUFFIXES) & (settled == "Low"), "Medium").otherwise(settled)
    return (
        F.when(_any_of(main, fixed.CRITICAL_TRIGGERS), "Critical")
        .when(_any_of(main, fixed.HIGH_TRIGGERS), "High")
        .when(_any_of(main, fixed.MEDIUM_TRIGGERS), F.when(base.isin("High", "Critical"), base).otherwise("Medium"))
        .otherwise(lifted)
    )


def title(c: Column, allowed: tuple[str, ...]) -> Column:
    """The allowed value that a text spells in any case; null if none. Allowed values have no white space at their ends, so a text that is one needs no strip."""
    names = F.create_map(*[F.lit(x) for a in allowed for x in (a.lower(), a)])
    return F.coalesce(F.try_element_at(names, F.lower(c)), F.try_element_at(names, F.lower(strip(c))))


def percent(value: Column) -> Column:
    """A percentage with two digits; null stays null."""
    return F.when(value.isNotNull(), F.format_string("%.2f%%", value))


def truthy(value: Column) -> Column:
    """1 for the texts 1 and true, else 0."""
    return F.coalesce(value.isin("1", "true"), F.lit(False)).cast("int")


def first_known(*values: Column, default: str = "--") -> Column:
    """The first of several values that is there, as text."""
    return F.coalesce(*[v.cast("string") for v in values], F.lit(default))


def fill(template: Column, **values: Column) -> Column:
    """A template with its {names} replaced."""
    return reduce(lambda c, kv: F.replace(c, F.lit("{" + kv[0] + "}"), kv[1]), values.items(), template)


def minor_noise(text: Column, seed: Column) -> Column:
    """One word replaced in about a quarter of the texts and a closing period dropped in about one of seven, by hash."""
    chance = lambda salt: F.pmod(F.xxhash64(seed, F.lit(salt)), F.lit(1000)) / 1000
    out = text
    for i, (old, new) in reversed(list(enumerate(fixed.NOISE_WORDS))):
        at = F.instr(text, old)
        once = F.concat(F.substring(text, F.lit(1), at - 1), F.lit(new), text.substr(at + len(old), F.length(text)))
        out = F.when((at > 0) & (chance(i + 10) < 0.4), once).otherwise(out)
    out = F.when(chance(1) < 0.25, out).otherwise(text)
    return F.when((chance(2) < 0.15) & out.endswith("."), F.substring(out, F.lit(1), F.length(out) - 1)).otherwise(out)


def reference_number(prefix: str, seed: Column) -> Column:
    """``prefix`` and six upper-case hexadecimal digits that ``seed`` fixes."""
    return F.concat(F.lit(prefix), F.upper(F.substring(F.md5(seed.cast("string")), 1, 6)))
