"""Word lists, tables and patterns of the catalogue rules."""

from __future__ import annotations

import unicodedata

# Letters without a decomposition, and what stands for them.
TRANSLITERATION = {
    "ß": "ss", "ẞ": "ss", "œ": "oe", "Œ": "oe", "æ": "ae", "Æ": "ae", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st",
    "ø": "o", "Ø": "o", "å": "a", "Å": "a", "ð": "d", "Ð": "d", "þ": "th", "Þ": "th", "ł": "l", "Ł": "l", "ı": "i", "İ": "i",
}

# The variant for file names, which keeps case and spells out three signs.
SLUG_TRANSLITERATION = {
    "ß": "ss", "ẞ": "SS", "œ": "oe", "Œ": "OE", "æ": "ae", "Æ": "AE", "ﬁ": "fi", "ﬂ": "fl", "ø": "o", "Ø": "O", "å": "a", "Å": "A",
    "ð": "d", "Ð": "D", "þ": "th", "Þ": "TH", "ł": "l", "Ł": "L", "ı": "i", "İ": "I", "&": "and", "@": "at", "+": "plus",
}

# Quotes that come in pairs around a whole value.
QUOTES = [("'", "'"), ('"', '"'), ("`", "`"), ("«", "»"), ("‹", "›"), ("“", "”")]

# Words that say nothing, as whole values.
NON_INFORMATIVE = """non no nein nao não na nc nd ns none null nil vide oui yes ja si sim empty inconnu unknown unbekannt desconocido
sconosciuto neant néant sans ohne senza sin sem keine kein nicht nichts niente nessuno nessuna ninguno ninguna nenhum nenhuma tbd tba
var variable void cancelled storno anulado 0 x""".split()
NON_INFORMATIVE_PATTERNS = [r"n/a", r"n\.a\.?", r"n\.d\.?", r"n\.s\.?", r"[-—–‐]+", r"\?+", r"\.+"]

# Abbreviations of column names, in the order in which they are expanded.
ABBREVIATIONS = [
    ("dim", "Dimensions"), ("dimens", "Dimensions"), ("long", "Longueur"), ("diam", "Diamètre"), ("diametre", "Diamètre"), ("haut", "Hauteur"),
    ("prof", "Profondeur"), ("ep", "Épaisseur"), ("epaiss", "Épaisseur"), ("larg", "Largeur"), ("pds", "Poids"), ("vol", "Volume"), ("surf", "Surface"),
    ("deb", "Débit"), ("debit", "Débit"), ("temp", "Température"), ("temper", "Température"), ("press", "Pression"), ("puiss", "Puissance"),
    ("pwr", "Puissance"), ("tens", "Tension"), ("intens", "Intensité"), ("freq", "Fréquence"), ("vit", "Vitesse"), ("vitess", "Vitesse"), ("cap", "Capacité"),
    ("mat", "Matière"), ("matiere", "Matière"), ("coul", "Couleur"), ("fin", "Finition"), ("ref", "Référence"), ("gar", "Garantie"),
    ("garantie", "Garantie"), ("cond", "Conditionnement"), ("nb", "Nombre"), ("qte", "Quantité"), ("qnte", "Quantité"),
    ("len", "Length"), ("wid", "Width"), ("hgt", "Height"), ("hght", "Height"), ("wgt", "Weight"), ("qty", "Quantity"), ("qnty", "Quantity"),
]

# Separators between key and value; the dashes only with blanks around them.
KEY_VALUE_SIGNS, KEY_VALUE_DASHES = ":=|→·", "—–"

# Notations of colour codes.
COLOUR_CODES = [
    r"ral\s*[-_]?\s*\d{4}[a-z]?", r"pantone\s+\d+[a-z]?(?:\s+[cu])?", r"pms\s+\d+[a-z]?", r"ncs\s+s?\s*\d{4}[-\s]?[a-z]\d*",
    r"#[0-9a-f]{3}", r"#[0-9a-f]{6}", r"#[0-9a-f]{8}",
    r"rgba?\s*\(\s*\d{1,3}\s*,\s*\d{1,3}\s*,\s*\d{1,3}(?:\s*,\s*[\d.]+)?\s*\)",
    r"hsla?\s*\(\s*\d{1,3}\s*,\s*\d{1,3}%\s*,\s*\d{1,3}%(?:\s*,\s*[\d.]+)?\s*\)",
]

# Units that follow a number, and currencies that may stand before it.
UNITS = """mm cm dm km m inches inch feet foot yards yard in ft yd mil kg mg g t pounds pound lbs lb oz tons ton gallons gallon gal ml cl dl hl
qt pt fl L l °C °F °K ° degrees degree deg % ‰ kWh mAh Wh Ah kW MW mW W Watts Watt watts watt kV mV V Volts Volt volts volt mA A Amps Amp amps amp
kJ J cal GHz MHz kHz Hz tr/min rpm tpm mbar bar psi kPa MPa Pa atm Tbit Gbit Mbit kbit bits bit TB GB MB kB To Go Mo ko Mpix Mpx dpi ppi kN Nm N
lbf sqft sqin sqyd sqm sqcm cuft cuin cuyd cum cucm mph kph kmh mps fps rps dBA dBa dB lm lux cd ms sec s mins min minutes minute hrs hr hours hour h
années année annees annee ans an mois semaines semaine jours jour years year months month weeks week days day Jahren Jahre Jahr Monaten Monate Monat
Wochen Woche Tagen Tage Tag Stunden Stunde años año meses mes días día dias dia semanas semana horas hora EUR USD GBP JPY CHF CAD AUD CNY KRW € $ £ ¥ ₩""".split()
CURRENCIES = "EUR USD GBP JPY CHF CAD AUD CNY KRW € $ £ ¥ ₩".split()

# Words without weight when names are compared.
STOP_WORDS = sorted(set("""de du des le la les un une et ou pour avec sans a à en sur sous par au aux the of and or for with in on at by to from
der die das den dem des und oder mit ohne für fur aus bei auf von zu di del della dei delle il lo gli una uno con senza per su tra fra
el los las unos unas y o sin para por al do da dos das um uma os as pelo pela sem sobre het een met zonder voor naar van tot aan bij over onder
det ett och eller med utan för fran ei og uten pa av oraz lub bez dla na od przez""".split()))

# Phrases that name a page's kind; contents before glossary before technical pages.
PAGE_KEYWORDS = {
    "toc": """table des matieres|sommaire|index alphabetique|index par couleur|index general|index produits|table of contents|alphabetical index
|color index|colour index|product index|general index|indice alfabetico|indice de colores|tabla de contenidos|indice general|indice de productos
|inhaltsverzeichnis|farbindex|produktindex|gesamtindex|indice dei colori|sommario|indice generale|indice prodotti|sumario|indice de cores
|tabela de conteudos|indice geral""",
    "glossaire": """glossaire des pictogrammes|glossaire pictogrammes|legende des pictogrammes|legende des symboles|pictogram glossary
|index of pictograms|key to symbols|symbol legend|icon legend|piktogramm|piktogramme|zeichenerklarung|symbolerklarung|symbollegende
|leyenda de pictogramas|leyenda de simbolos|glosario de pictogramas|legenda dei pittogrammi|legenda dei simboli|legenda dos pictogramas|legenda dos simbolos""",
    "tech": """cahier technique|aide technique|fiche technique|synoptique|notice technique|donnees techniques|caracteristiques techniques
|technical sheet|technical guide|technical data|technical specifications|data sheet|datasheet|spec sheet|ficha tecnica|datos tecnicos|guia tecnica
|especificaciones tecnicas|technisches datenblatt|technische daten|technische spezifikationen|datenblatt|scheda tecnica|dati tecnici
|specifiche tecniche|dados tecnicos|especificacoes tecnicas""",
}
PAGE_KEYWORDS = {kind: [x.replace("\n", "") for x in text.split("|")] for kind, text in PAGE_KEYWORDS.items()}

# Opening words of legal notices.
LEGAL_OPENINGS = r"Cr[ée]dit\s+photo|Photo\s+credit|Document\s+non\s+contractuel|Tous\s+droits\s+r[ée]serv[ée]s|All\s+rights\s+reserved"

# Width of a character in parts of the font size; the first class that has it counts.
WIDTHS = [("[A-Z]", 0.65), ("[0-9]", 0.6), ("[À-ÖØ-Þ]", 0.65), ("[ :.,]", 0.3), ("[mw]", 0.7), ("[iltfj!|]", 0.35)]
OTHER_WIDTH = 0.55

# Glyphs that fonts lack, and what is printed for them.
GLYPHS = {
    "’": "'", "‘": "'", "‚": ",", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "«": '"', "»": '"', "‹": "'", "›": "'", "ʼ": "'", "ʹ": "'", "ʻ": "'", "ˈ": "'",
    "′": "'", "″": '"', "‴": "'''", "–": "-", "—": "-", "‒": "-", "―": "-", "−": "-", "‐": "-", "‑": "-", "\u00ad": "-", "\u00a0": " ", "\u202f": " ", "\u2003": " ", "\u2002": " ", "\u2009": " ", "\u200a": " ", "\u200b": "", "\u2007": " ", "\ufeff": "", "…": "...", "‧": ".", "·": ".", "•": "-", "◦": "-", "▪": "-", "▫": "-", "∙": ".", "⋅": ".", "∗": "*", "※": "*", "⁂": "*", "⁕": "*",
    "→": "->", "←": "<-", "↑": "^", "↓": "v", "↔": "<->", "↕": "^v", "⇒": "=>", "⇐": "<=", "⇑": "^^", "⇓": "vv", "⇔": "<=>", "⇕": "^^vv",
    "²": "2", "³": "3", "¹": "1", "⁰": "0", "⁴": "4", "⁵": "5", "⁶": "6", "⁷": "7", "⁸": "8", "⁹": "9", "₀": "0", "₁": "1", "₂": "2", "₃": "3", "₄": "4",
    "¼": "1/4", "½": "1/2", "¾": "3/4", "⅓": "1/3", "⅔": "2/3", "⅕": "1/5", "⅖": "2/5", "⅗": "3/5", "⅘": "4/5", "⅙": "1/6", "⅚": "5/6", "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8",
    "×": "x", "÷": "/", "±": "+/-", "≤": "<=", "≥": ">=", "≠": "!=", "≈": "~", "≃": "~", "≅": "~", "∞": "inf", "√": "sqrt", "∑": "sum", "∆": "delta", "π": "pi", "∂": "d", "∇": "nabla",
    "⌀": "diam ", "∅": "diam ", "€": "EUR", "£": "GBP", "¥": "YEN", "¢": "c", "₩": "KRW", "₹": "INR", "₪": "ILS", "฿": "THB", "₣": "CHF", "₤": "GBP", "₿": "BTC",
    "©": "(c)", "®": "(r)", "™": "TM", "℠": "SM", "§": "S", "¶": "P", "†": "+", "‡": "++", "№": "No", "℮": "e", "‱": "pm10k", "‰": "pm",
    "œ": "oe", "Œ": "OE", "æ": "ae", "Æ": "AE", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st",
}

# Colour and finish names, lower-cased and without accents.
COLOURS = """inox|chrome|chrome poli|chrome brosse|chrome mat|noir|blanc|gris|beige|creme|sable|taupe|naturel|dore|argente|cuivre|bronze|laiton|nickel
|black|white|grey|gray|cream|sand|natural|gold|silver|copper|brass|chrom|schwarz|weiss|grau|silber|kupfer|messing|cromo|cromado|negro|blanco|crema
|dorado|plateado|cobre|laton|niquel|cromato|nero|bianco|grigio|dorato|argentato|rame|ottone|nichel|preto|branco|cinza|cinzento|bege|dourado|prateado|latao
|rouge|bleu|vert|jaune|rose|violet|orange|marron|bordeaux|turquoise|fuschia|indigo|lavande|bleu marine|bleu nuit|bleu ciel|bleu canard|bleu petrole
|rouge bordeaux|rouge brique|rouge rubis|vert sapin|vert olive|vert amande|vert menthe|vert pomme|gris anthracite|gris perle|gris souris|gris ardoise
|rose poudre|rose pale|jaune moutarde|jaune paille|beige sable|noir mat|noir profond|navy blue|sky blue|royal blue|midnight blue|forest green|olive green
|mint green|apple green|pearl grey|charcoal grey|slate grey|powder pink|mustard yellow|matte black|red|blue|green|yellow|pink|purple|brown|burgundy|fuchsia
|lavender|rot|blau|gruen|grun|gelb|rosa|lila|braun|rojo|azul|verde|amarillo|morado|rosso|blu|giallo|viola|marrone|vermelho|amarelo|roxo|castanho
|mat|mate|brillant|satine|poli|brosse|martele|patine|vieilli|antique|laque|vernis|anodise|galvanise|depoli|translucide|transparent|metallise
|matt|matte|glossy|satin|polished|brushed|hammered|vintage|lacquered|varnished|anodized|galvanized|sandblasted|frosted|translucent|plated|powder coat
|distressed|glanz|glanzend|satiniert|poliert|gebuerstet|lackiert|eloxiert|verzinkt|mattiert|brillante|satinado|pulido|cepillado|lacado|anodizado
|galvanizado|esmerilado|opaco|lucido|satinato|pulito|spazzolato|laccato|anodizzato|zincato|smerigliato""".replace("\n", "").split("|")

# Spec categories by words in the key; the first that matches counts.
SPEC_CATEGORIES = [
    ("TECHNIQUE", """mati(è|e)re|material|materia|m(é|e)canisme|mechanism|meccanismo|m(é|e)ca\\b|d(é|e)bit|flow|pression|pressure|druck|presion|temp(é|e)rature|temperature
|norme|standard|certif|(é|e)nerg(é|e)tique|energy|(é|e)nergi|raccord|fitting|alim|power|cartouche|cartridge"""),
    ("DIMENSIONS", """longueur|length|longitud|lunghezza|comprimento|laenge|l(ä|a)nge|diam(è|e)tre|diameter|diametro|durchmesser|hauteur|height|altura|altezza|h(ö|o)he
|largeur|width|anchura|larghezza|breite|profondeur|depth|profundidad|profondit|tiefe|(é|e)paisseur|thickness|espesor|spessore|dicke|taille|size|tama|format
|capacit|capacity|capacidad|capacita|encombrement|entr(é|e)es?\\s+axes"""),
    ("FINITION", "coloris|finition|finish|couleur|color|colour|farbe|cor\\b|colore|aspect|aspecto|texture|textur|oberfl(ä|a)che|acabado|acabamento|finitura"),
    ("GARANTIE", "garantie|warranty|garant[ií]a|garanzia|dur(é|e)e|duration|durata|duracao|duraci(ó|o)n|dauer|durabilit|durability|sav\\b|service"),
    ("CONDITIONNEMENT", """conditionnement|emballage|packaging|embalaje|embalagem|imballaggio|verpackung|condit\\.?|nature.*conditionnement|carton|karton|cartone|caja|caixa
|bo[iî]te|box|scatola|coque|blister"""),
]
SPEC_CATEGORIES = [(name, words.replace("\n", "")) for name, words in SPEC_CATEGORIES]


def accent_table() -> tuple[str, str]:
    """Letters that decompose into a base letter and combining marks, and their base letters."""
    letters, bases = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(0x300 <= ord(c) <= 0x36F for c in parts[1:]):
            letters.append(chr(code))
            bases.append(parts[0])
    return "".join(letters), "".join(bases)
