"""Name, path and text helpers as column expressions; all run inside code generation on the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The start or end of a word in any script; the JVM's own ``\b`` takes only plain letters as letters.
WORD_EDGE = r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"
# Words dropped as legal form when entities are resolved.
LEGAL_FORM = rf"(?iu){WORD_EDGE}(l\.?l\.?c|l\.?l\.?p|inc|incorporated|corp|corporation|co|company|ltd|limited|lp|pllc|pc|the){WORD_EDGE}"
# Words dropped from the end of a name that is searched for in running text.
TRAILING_FORMS = ["inc", "inc.", "llc", "llp", "l.l.c.", "lp", "ltd", "ltd.", "corp", "corp.", "corporation", "co", "co.", "company", "plc", "n.a.", "na", "the"]


def norm_aggressive(name: Column) -> Column:
    """Lower case, without legal forms, letters and digits only."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), LEGAL_FORM, " "), "[^a-z0-9]+", "")


def norm_light(name: Column) -> Column:
    """Lower case, letters and digits only; the legal form stays."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def name_tokens(name: Column) -> Column:
    """Distinct tokens of three or more letters, without legal forms."""
    parts = F.split(F.regexp_replace(F.lower(name), LEGAL_FORM, " "), "[^a-z0-9]+")
    return F.array_distinct(F.filter(parts, lambda t: F.length(t) > 2))


def path_template(path: Column) -> Column:
    """A path with every run of digits as ``#``."""
    return F.regexp_replace(path, r"\d+", "#")


def source_group(path: Column) -> Column:
    """``<suffix>::<templated path>`` of a relative path."""
    return F.concat(F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)), F.lit("::"), path_template(path))


def locator_parts(locator: Column) -> tuple[Column, Column]:
    """Group and id of ``group::id``, split at the last ``::`` because groups hold one themselves."""
    return F.regexp_extract(locator, r"^(.*)::(.*?)$", 1), F.regexp_extract(locator, r"^(?:.*)::(.*?)$", 1)


def slug(text: Column, most: int = 60) -> Column:
    """Lower-case words joined by hyphens, at most ``most`` characters; 'untitled' if nothing is left."""
    words = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(words, 1, most), "-+$", "")
    return F.when(cut == "", "untitled").otherwise(cut)


def safe_id(native_id: Column, most: int = 80) -> Column:
    """File-name-safe id; one that was changed or cut carries eight digits of its SHA-1."""
    raw = F.coalesce(native_id, F.lit(""))
    clean = F.regexp_replace(F.regexp_replace(raw, "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")
    clean = F.when(clean == "", "id").otherwise(clean)
    changed = (clean != raw) | (F.length(clean) > most)
    return F.when(changed, F.concat(F.regexp_replace(F.substring(clean, 1, most), "-+$", ""), F.lit("-"), F.substring(F.sha1(raw), 1, 8))).otherwise(clean)


def phrase_of_name(name: Column) -> Column:
    """The words of a name as running text has them: no trailing legal forms, no leading article; null if none are left."""
    words = F.regexp_extract_all(name, F.lit(r"([A-Za-z0-9][A-Za-z0-9&.-]*)"), 1)
    form = F.array(*[F.lit(x) for x in TRAILING_FORMS])
    is_form = F.transform(words, lambda w: F.array_contains(form, F.regexp_replace(F.lower(w), "[.,]+$", "")) )
    last = F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: F.when((i <= F.size(words)) & ~F.get(is_form, i - 1), i).otherwise(0)))
    kept = F.slice(words, 1, last)
    return F.nullif(F.regexp_replace(F.array_join(kept, " "), "(?i)^(the )+", ""), F.lit(""))


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Lower-case letters that decompose to a letter and marks, with their letters, and the marks, which go to nothing."""
    marked, bare = [], []
    for code in (*range(0xC0, 0x590), *range(0x1E00, 0x2000)):
        c = chr(code)
        plain = unicodedata.normalize("NFD", c)
        if c == c.lower() and len(plain) > 1 and all(unicodedata.combining(x) for x in plain[1:]):
            marked.append(c), bare.append(plain[0])
    return "".join(marked) + "".join(map(chr, range(0x300, 0x370))), "".join(bare)


def fold_accents(text: Column) -> Column:
    """Lower case without diacritics, in any Latin, Greek or Cyrillic text, composed or not."""
    return F.translate(F.lower(text), *_accents())


def words_of_text(text: Column) -> Column:
    """Tokens as a full-text index has them: accents folded, case folded, runs of letters and digits."""
    return F.filter(F.split(fold_accents(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def lead_label(claim: Column) -> Column:
    """What a lead is called: the brackets after "for", else the last brackets, else the claim's beginning."""
    within = r"\(([^)]{4,160})\)"
    named, every = F.regexp_extract(claim, r"\bfor " + within, 1), F.regexp_extract_all(claim, F.lit(within), 1)
    start = F.coalesce(F.nullif(F.substring(claim, 1, 60), F.lit("")), F.lit("lead"))
    return F.when(named != "", named).when(F.size(every) > 0, F.element_at(every, -1)).otherwise(start)


def group_slug(group: Column) -> Column:
    """Slug of a source group without its suffix part."""
    return slug(F.regexp_replace(F.coalesce(group, F.lit("")), "^[^:]*::", ""), 40)


def quarter_of(iso: Column) -> tuple[Column, Column]:
    """Year text and quarter name of ISO date text; nulls where there is no month."""
    month = F.substring(iso, 6, 2).try_cast("int")
    names = F.array(*[F.lit(f"{x}_quarter") for x in ("first", "second", "third", "fourth")])
    good = (F.length(iso) >= 7) & month.between(1, 12)
    return F.when(good, F.substring(iso, 1, 4)), F.when(good, F.get(names, F.floor((month - 1) / 3).cast("int")))
