"""Text keys and cleaning. Null counts as empty unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and what they fold to.
ACCENTED = "àâäáãåçèéêëìíîïñòóôöõùúûüýÿÀÂÄÁÃÅÇÈÉÊËÌÍÎÏÑÒÓÔÖÕÙÚÛÜÝ"
FOLDED = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
#: Words that carry no meaning of their own, for term weights and for the overlap of fragments.
STOPWORDS = "a afin ainsi and au aux avec ce ces cet cette dans de des du en et for il in la le les leur leurs notre nous of on ou par pour que qui sur the to un une".split()
FRAGMENT_STOPWORDS = "ainsi avec cette comme dans des elle elles est les leur leurs mais par pour que qui sur une vers".split()


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def squeezed(text: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(blank(text), r"\s+", " "))


def folded(text: Column) -> Column:
    """Without accents; other letters stay. A text of one byte a letter has none and is passed on as it is."""
    return let(blank(text), lambda t: F.when(F.octet_length(t) == F.length(t), t).otherwise(F.translate(t, ACCENTED, FOLDED)))


def block_key(text: Column) -> Column:
    """Lower-case letters (French accents kept) and digits, single-spaced."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(blank(text)), "[^a-zàâäçéèêëîïôöùûüÿœ0-9 ]", " "), " +", " "))


def compact_key(text: Column) -> Column:
    """Accent-free lower-case letters and digits with nothing between them."""
    return F.regexp_replace(F.lower(folded(text)), "[^a-z0-9]", "")


def span_key(text: Column) -> Column:
    return F.lower(squeezed(text))


def meaningful_tokens(text: Column) -> Column:
    """Distinct accent-free tokens of three letters or more that are no stop-words, sorted."""
    tokens = F.regexp_extract_all(F.lower(folded(text)), F.lit("[a-z0-9]{3,}"), F.lit(0))
    return F.array_sort(F.array_except(F.array_distinct(tokens), F.array(*map(F.lit, FRAGMENT_STOPWORDS))))


def tfidf_tokens(text: Column) -> Column:
    """Tokens longer than two letters that are neither stop-words nor plain numbers, repeats kept; page marks are none."""
    t = F.regexp_replace(F.lower(blank(text)), r"\[(?:pdf|p)\.?\s*\d+(?:\s*[-–]\s*\d+)?\]", " ")
    tokens = F.transform(F.regexp_extract_all(folded(t), F.lit(r"[\p{L}\p{N}_']+"), F.lit(0)), lambda x: F.regexp_replace(x, "^['_]+|['_]+$", ""))
    return F.filter(tokens, lambda x: (F.length(x) > 2) & ~x.isin(STOPWORDS) & ~x.rlike("^[0-9]+$"))


def numeric_tokens(text: Column) -> Column:
    """Distinct space-separated tokens with a digit, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(squeezed(text), " "), lambda t: t.rlike("[0-9]"))))


def masked_numbers(text: Column) -> Column:
    """Numbers, with their separators and percent signs, as ``<nombre>``."""
    return squeezed(F.regexp_replace(blank(text), r"[0-9]+(?:[.,  ][0-9]+)*(?: ?%)?", " <nombre> "))


def footnote_key(text: Column) -> Column:
    """Lower-case, with dates and page ranges masked."""
    t = F.regexp_replace(F.lower(blank(text)), r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", "__DATE__")
    return squeezed(F.regexp_replace(t, r"pages? [0-9]+(?: ?[-–à] ?[0-9]+)?", "__PAGE__"))


def heading_key(text: Column) -> Column:
    """Without page markers, ``T22`` prefixes and punctuation."""
    t = F.regexp_replace(blank(text), r"\[pdf\.[0-9]+\]", " ")
    t = F.regexp_replace(F.lower(folded(t)), r"^\s*t[0-9]{1,3}\s+", "")
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def without_controls(text: Column) -> Column:
    return F.regexp_replace(text, "[\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f]", "")


def truncated(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.left(text, F.lit(limit))), F.lit("..."))).otherwise(text)


def joined_letters(text: Column) -> Column:
    """``T o t a l`` as ``Total``: single letters with single spaces between them close up."""
    return F.regexp_replace(blank(text), r"(?<=(?:^|\s)\p{L}) (?=\p{L}(?:\s|$))", "")


def unstuttered(text: Column) -> Column:
    """Tokens of four characters or more in which every character is doubled are halved."""
    once = lambda w: F.when((F.length(w) >= 4) & w.rlike(r"^(?:(.)\1)+$"), F.regexp_replace(w, r"(.)\1", "$1")).otherwise(w)
    return F.array_join(F.transform(F.split(blank(text), " "), once), " ")


def sentences(text: Column) -> Column:
    """Cut after ``.``, ``!`` or ``?`` before a capital; empty parts are dropped."""
    return F.filter(F.split(squeezed(text), r"(?<=[.!?]) +(?=\p{Lu})"), lambda s: s != "")


def unescaped(text: Column) -> Column:
    """The five HTML entities and no-break spaces; the ampersand last."""
    t = text
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), (" ", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def surface(text: Column) -> Column:
    """Entities resolved, odd spaces plain, and no space before or inside punctuation; nothing else changes."""
    t = unescaped(F.regexp_replace(blank(text), "\u200b", ""))
    t = F.regexp_replace(t, "[ \\t\\f\\x0B\u00a0\u202f]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\s+([,.;:!?])", "$1"), r"([«(\[])\s+", "$1")
    return F.regexp_replace(F.regexp_replace(t, r"\s+([»)\]])", "$1"), r"^\s+|\s+$", "")


def adjacent_key(text: Column) -> Column:
    """The key by which neighbours count as the same."""
    return squeezed(F.lower(surface(text)))


#: Phrases that stand for one another between banks, and signs that carry no meaning of their own.
SEMANTIC_PHRASES = [
    (r"\bcadre de capacité totale d[’']absorption des pertes\b", "un cadre renforcé d'absorption des pertes"),
    (r"\bligne directrice sur le levier\b", "des exigences de levier"),
    (r"\bréformes de\s+[IVX]{1,4}\b", "des réformes prudentielles"),
    (r"\bexigences?\s+réglementaires?\b", "des exigences prudentielles"),
    (r"\bexigence\s+réglementaire\s+minimale\b", "exigence minimale"),
    (r"\bBISM\b", "les banques d'importance systémique"),
    (r"\bVaR\b", "la mesure de risque de marché"),
    (r"\b(?:OSFI|BSIF|Bâle|Basel|TLAC|LCR|NSFR|CET1|Tier\s*1|Tier\s*2|Pilier\s*[123]|IFRS|IAS|NIIF|BISM|VaR)\b", "<regulateur>"),
]
SEMANTIC_SIGNS = [(r"\b\S*\d\S*\b", "<nombre>"), (r"\b[IVX]{1,4}\b", ""), ("[%‰]+", ""), (r"(?iu)\b(?:pb|pbs|bp|bps|points?\s+de\s+base)\b", ""), (r"\[[^\]]*\]", ""), (r"\([^)]*\d[^)]*\)", ""), (r"\s*[-–—]\s*", " ")]
SEMANTIC_SUBJECTS = [(r"\b(?:Le|La|Les)\s+a\b", "La banque a"), (r"\bLa Banque\b", "La banque"), (r"\bLe Groupe\b", "La banque"), (r"(?iu)\bConseil d'administration\b", "gouvernance"), (r"\s+([,;:.])", "$1"), (r"\s+", " ")]


def semantic(text: Column) -> Column:
    """Numbers, regulators and bank names neutralised, so that two sentences of one meaning look alike."""
    t = F.trim(blank(text))
    for pattern, put in [(f"(?iu){p}", x) for p, x in SEMANTIC_PHRASES] + SEMANTIC_SIGNS + SEMANTIC_SUBJECTS:
        t = F.regexp_replace(t, pattern, put)
    return F.trim(F.regexp_replace(t, r"^[ ,;:.]+|[ ,;:.]+$", ""))


def explanation(text: Column, limit: int = 1200) -> Column:
    return F.left(squeezed(text), F.lit(limit))


def truncated_at_sentence(text: Column, limit: int) -> Column:
    """Cut behind the last sentence that ends in the window, else at a space; never in a word."""
    t, window, least = blank(text), F.left(blank(text), F.lit(limit)), max(40, limit // 4)
    ends = [F.nullif(F.regexp_extract(window, rf"(?s)^(.{{{least},}}[{mark}]){gap}", 1), F.lit("")) for gap in (" ", "\n") for mark in ".!?"]
    sentence = F.coalesce(*ends, F.lit(""))
    at_word = F.regexp_extract(window, rf"(?s)^(.{{{least},}}) ", 1)
    bare = F.regexp_replace(F.when(at_word != "", at_word).otherwise(window), "[ ,;:]+$", "")
    return F.when(F.length(t) <= limit, t).when(sentence != "", F.rtrim(sentence)).otherwise(F.concat(bare, F.lit(".")))


def head_and_tail(text: Column, limit: int, mark: str = " [...] ") -> Column:
    """The start and the end of a text that is too long."""
    half = (limit - len(mark)) // 2
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(half)), F.lit(mark), F.right(text, F.lit(half)))).otherwise(blank(text))
