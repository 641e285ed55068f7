"""Small rules on names, messages, labels and keys as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.text import strip_accents, trim

# Headers of columns that say something to the shop's software only; matched without accents, in any case.
TECHNICAL = r"^(bdd[_.]|libelle[_ ]?(s?s)?famille|sfamille|ssfamille|gencod|gtin|ean|upc|isbn|attribut|statut|marque$|nf$|code\s?produit$|id$|uid$|uuid$|guid$|fournisseur$|supplier$|vendor$|stock$|warehouse$|entrepot$|obsolete$|archive$|deleted$|inactif$|version$|revision$|rev$|created_at$|updated_at$|date_creation$|date_modification$|date_maj$)"

# Patterns of headers by role, those in front first; matched without accents, in any case.
ROLES = {
    "name": [
        r"^designation",
        r"^(nom|name|titre|title|libelle.*produit|libelle.*designation)",
        r"^(product|produit|label|bezeichnung|denominacion|denomination)",
        r"^(prodotto|nome|articolo|descrizione|descricao|descripcion|description|produkt|produkter|namn|nazwa|nazwa.*produktu)",
        r"^(navn|vare|varenavn|betegnelse|beteckning|varunamn)",
        r"^(item.*name|product.*name|item.*title|item.*description|display.*name|short.*name)",
        r"^(intitule|short.?desc(ription)?|long.?desc(ription)?)",
    ],
    "sku": [r"(sku|ref|reference|referenz|referencia|riferimento|code|codigo|id\b|ean|gencod|gtin|isbn|article|artikel|articulo|artigo|barcode|kod|nr\b|numer|nummer|item.*code|product.*code|art\.?\s?nr|varenr|varenummer|artikelnr|model|modello|modelo|modele|modell|part.?(number|no|nr)|p/n)"],
    "color": [r"^(\d+\s+)?(couleur|color|colour|finition|finish|teinte|coloris|hue|shade|tint|tonalite|farbe|farbton|ausfuhrung|tonalidad|acabado|matiz|colore|finitura|tonalita|tinta|cor\b|acabamento|tonalidade|farve|farg|kolor)"],
    "image": [r"^(image|photo|picture|img|visuel|illustration|bild|bilde|billede|imagen|immagine|imagem|foto|abbildung|grafik|fotografia|miniature|thumbnail|vignette|snapshot|cover|obraz|zdjecie|image[_\s-]?url|photo[_\s-]?url|product[_\s-]?image)s?$"],
    "section": [r"libelle[_ ]?ssfamille", r"libelle[_ ]?sfamille", r"libelle[_ ]?famille", r"^(section|categorie|category|categoria|kategorie|rayon|gamme|rubrik|abteilung|seccion)"],
    "family": [r"^libelle[_ ]?famille$", r"^(famille|family|familie|familia|univers|universe)$"],
}

# A reference to a page inside a text, and a label that is a page number with or without a sign before it.
PAGE_REFERENCE = r"\b(?:page|pag(?:ina)?|pág(?:ina)?|seite)\.?\s+[0-9]{1,4}\b|\b[ps]\.\s*[0-9]{1,4}\b"
PAGE_LABEL = r"^\s*(?:p(?:age|ag|ág|gs?|agina|ágina)?\.?\s+|p\.?\s*|seite\s+|s\.\s*|[→▸▶▷►●•‣]\s+)?[0-9]{1,4}\.?\s*$"

# What messages of failed calls say.
AUTH = r"auth\s+expir|claude\s+login|401|authentication_error|invalid\s+authentication"
QUOTA = r"(?:^|[^a-z0-9])429(?:[^a-z0-9]|$)|quota|rate.?limit|circuit ouvert"
OVERLOADED = r"(?:^|[^0-9])(500|502|503|504)(?:[^0-9]|$)|overload|high demand|experiencing high|try again later|temporarily unavailable|internal error"
UNAVAILABLE = r"(?:^|[^0-9])404(?:[^0-9]|$)|not found|not supported|not available|does not exist|unavailable"


def says(x: Column, pattern: str) -> Column:
    return F.coalesce(x.rlike(f"(?i){pattern}"), F.lit(False))


def is_technical_column(header: Column) -> Column:
    return says(strip_accents(header), TECHNICAL)


def family_ribbon(family: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The ribbon of the first rule with a keyword in the family (in any case, without accents); the family in lower case without one."""
    low = F.lower(strip_accents(family))
    out = F.lower(family)
    for ribbon, keywords in reversed(rules):
        hit = F.lit(False)
        for k in keywords:
            if k:
                hit = hit | F.contains(low, F.lower(strip_accents(F.lit(k))))
        out = F.when(hit, ribbon).otherwise(out)
    return F.when(family != "", out)


def font_suffix(font: Column, fallback: str) -> Column:
    """What stands behind the last hyphen of a font's name; the whole name without one, the fallback for an empty name."""
    return F.when(F.contains(font, F.lit("-")), F.element_at(F.split(font, "-"), -1)).when(font != "", font).otherwise(fallback)


def sample_text(texts: Column, stop: int = 150, most: int = 200) -> Column:
    """Texts that aren't blank, joined until more than `stop` characters are there; cut at `most`."""
    filled = F.filter(F.transform(texts, trim), lambda t: t != "")
    joined = F.aggregate(filled, F.lit(""), lambda a, t: F.when(a == "", t).when(F.length(a) > stop, a).otherwise(F.concat(a, F.lit(" | "), t)))
    return F.substring(joined, 1, most)


def request_tokens(texts: Column, images: Column, most_out: Column) -> Column:
    """Rough tokens of a model request: four characters each, 300 an image, and what the answer may have (1024 if not said)."""
    parts = F.aggregate(texts, F.lit(0).cast("long"), lambda a, t: a + F.ceil(F.length(t) / 4))
    return (parts + 300 * images + F.coalesce(most_out, F.lit(1024))).cast("long")


def identifiers(values: Column) -> Column:
    """Distinct trimmed values of 3 characters or more, long ones first, else in their order."""
    known = F.array_distinct(F.filter(F.transform(values, trim), lambda v: F.length(v) >= 3))
    placed = F.transform(known, lambda v, i: F.struct((-F.length(v)).alias("n"), i.alias("i"), v.alias("v")))
    return F.transform(F.array_sort(placed), lambda x: x["v"])


def current_number(x: Column) -> Column:
    """The digits of a page-number label as a number; null without one, or if it is 0."""
    digits = F.regexp_replace(x, "[^0-9]", "")
    return F.nullif(F.when(digits != "", F.try_to_number(F.substring(digits, -9, 9), F.lit("999999999"))).cast("int"), F.lit(0))


def contents_tail(x: Column) -> Column:
    """Digits at the end of a contents entry, behind which only blanks and dots stand, with these; the whole entry without such digits, or if
    it has nothing else."""
    tail = F.regexp_extract(x, r"([0-9]+[ .\t]*)$", 1)
    return F.when((tail == "") | (tail == x), x).otherwise(tail)


def tail_left(x: Column, left: Column, right: Column) -> Column:
    """Where the tail of a contents entry begins, in proportion to its length."""
    return right - (right - left) * F.length(contents_tail(x)) / F.length(x)


def trimmed_keys(keys: Column) -> Column:
    """Distinct trimmed keys of 1 to 79 characters."""
    return F.array_distinct(F.filter(F.transform(keys, trim), lambda k: F.length(k).between(1, 79)))


def cache_key(prompt: Column, *blobs: Column) -> Column:
    """SHA-256 of a prompt and the bytes that go with it, in order."""
    return F.sha2(F.concat(F.encode(prompt, "utf-8"), *blobs), 256)


def only_known(value: Column, headers: Column) -> Column:
    """A reply's value where it is one of the headers; null else."""
    return F.when(F.array_contains(headers, value), value)


def safe_description(text: Column, label: Column, requested: Column, most: int | None = None) -> Column:
    """A model's description, trimmed, where its label was asked for and it says something (in at most `most` characters)."""
    t = trim(text)
    ok = F.array_contains(requested, label) & (t != "")
    return F.when(ok & (F.length(t) <= most) if most else ok, t)
