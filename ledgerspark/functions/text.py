"""Text, identifier and date functions as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks and the letters under them.
MARKED = "áàâäãåéèêëíìîïóòôöõúùûüýÿñç"
PLAIN = "aaaaaaeeeeiiiiooooouuuuyync"
# Month abbreviations in Spanish and English.
MONTHS = {"ene": 1, "jan": 1, "feb": 2, "mar": 3, "abr": 4, "apr": 4, "may": 5, "jun": 6, "jul": 7, "ago": 8, "aug": 8, "sep": 9, "set": 9, "oct": 10, "nov": 11, "dic": 12, "dec": 12}
# Words of company names that tell nobody apart.
GENERIC = ["S", "A", "SA", "SAS", "LTDA", "LIMITADA", "CIA", "CO", "INC", "DE", "DEL", "LA", "EL", "LOS", "LAS", "Y", "E", "EN", "SOCIEDAD", "ANONIMA", "GRUPO", "EMPRESA", "COMERCIALIZADORA", "DISTRIBUIDORA", "SERVICIOS", "SUMINISTROS"]

# Words that tell a column of the bank's table, in the order in which they are tried, with its field.
COLUMN_WORDS = {"transaccion": "kind", "destinatario": "payee", "destino": "account", "celular": "phone", "referencia": "reference", "valor": "value"}
# Words of the bank's form and of banks, which are never part of a payee's name; and those that stand in the name's own column.
FORM_WORDS = [
    "abono", "cuenta", "cuentas", "ahorro", "ahorros", "corriente", "banco", "bancos", "bancolombia", "davivienda", "occidente", "villas", "bbva", "av", "popular", "agrario",
    "caja", "social", "itau", "scotiabank", "colpatria", "falabella", "pichincha", "cop", "transferencia", "debito", "credito", "pago", "pagos", "abonoa", "de", "del", "la", "el", "cops", "copz", "cor",
]
NAME_COLUMN_WORDS = ["abono", "abonoa", "cuenta", "a"]


def fold(c: Column) -> Column:
    """Lower case without marks."""
    return F.translate(F.lower(c), MARKED, PLAIN)


def unmark(c: Column) -> Column:
    """Without marks, case kept."""
    return F.translate(c, MARKED + MARKED.upper().replace("Ÿ", "Ÿ"), PLAIN + PLAIN.upper())


def normalise(c: Column) -> Column:
    return F.btrim(F.regexp_replace(fold(c), r"\s+", " "), F.lit(" .:"))


def tolerant(c: Column) -> Column:
    """Letters and digits that scans mix up fall together."""
    return F.translate(fold(c), "l105", "iios")


def compact(c: Column) -> Column:
    return F.regexp_replace(fold(c), "[^a-z0-9]", "")


def label(c: Column) -> Column:
    """A sheet's label in lower case, without hard spaces, colons at its end and the marks of Spanish vowels and ñ."""
    bare = F.trim(F.regexp_replace(F.trim(F.replace(c, F.lit("\u00a0"), F.lit(" "))), ":+$", ""))
    return F.translate(F.lower(bare), "áéíóúñ", "aeioun")


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")


def whole_number(c: Column) -> Column:
    """Digits without leading zeros; all zeros are 0; none is blank."""
    d = digits(c)
    return F.when(d == "", "").otherwise(F.coalesce(F.nullif(F.ltrim(d, F.lit("0")), F.lit("")), F.lit("0")))


def trimmed_digits(c: Column) -> Column:
    """Digits without leading zeros, all zeros kept."""
    d = digits(c)
    return F.coalesce(F.nullif(F.ltrim(d, F.lit("0")), F.lit("")), d)


def alnum(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]", "")


def same_number(a: Column, b: Column) -> Column:
    return (alnum(a) != "") & (alnum(a) == alnum(b))


def same_tax_id(a: Column, b: Column) -> Column:
    """Digits are equal, or one has a check digit more; blank ids are never equal."""
    x, y = digits(a), digits(b)
    longer, shorter = F.when(F.length(x) > F.length(y), x).otherwise(y), F.when(F.length(x) > F.length(y), y).otherwise(x)
    gap = F.length(longer) - F.length(shorter)
    return (shorter != "") & ((x == y) | ((gap == 1) & (F.substring(longer, F.lit(1), F.length(longer) - 1) == shorter)))


def tax_id_pattern(c: Column) -> Column:
    """A pattern that finds the id with separators between its digits and an optional check digit; long ids may lack the last digit."""
    d = digits(c)
    spread = lambda x: F.array_join(F.filter(F.split(x, ""), lambda y: y != ""), r"[.,\s-]{0,2}")
    short = F.substring(d, F.lit(1), F.length(d) - 1)
    body = F.when(F.length(d) >= 10, F.concat(F.lit("(?:"), spread(d), F.lit("|"), spread(short), F.lit(")"))).otherwise(spread(d))
    return F.concat(F.lit("(?<![0-9])"), body, F.lit(r"(?:[.,\s-]{0,2}[0-9])?(?![0-9])"))


def clean_tax_id(c: Column) -> Column:
    return F.substring_index(F.regexp_replace(c, "[^0-9-]", ""), "-", 1)


def clean_invoice(c: Column) -> Column:
    head = F.trim(F.substring_index(F.upper(F.trim(c)), "-", 1))
    return F.when(head.rlike("^[0-9]+$"), whole_number(head)).otherwise(head)


def account(c: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(c, F.lit("")), r"[0-9][0-9\s.\-]{5,}[0-9]", 0)
    return F.btrim(F.regexp_replace(raw, r"\s", ""), F.lit("-"))


def _iso(y: Column, m: Column, d: Column) -> Column:
    return F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))


def bank_date(c: Column) -> Column:
    """Day, month and year with slashes or dashes, or with a month's name that may touch the year; else blank."""
    t = unmark(F.coalesce(c, F.lit("")))
    slashes, named = r"([0-9]{1,2})\s*[/-]\s*([0-9]{1,2})\s*[/-]\s*([0-9]{4})", r"([0-9]{1,2})\s*([A-Za-z]{3,})\.?\s*([0-9]{4})"
    month = F.element_at(F.create_map(*[F.lit(x) for k, v in MONTHS.items() for x in (k, str(v))]), F.lower(F.substring(F.regexp_extract(t, named, 2), 1, 3)))
    part = lambda p, i: F.regexp_extract(t, p, i)
    return F.when(t.rlike(slashes), _iso(part(slashes, 3), part(slashes, 2), part(slashes, 1))).when(month.isNotNull(), _iso(part(named, 3), month, part(named, 1))).otherwise("")


def order_date(c: Column) -> Column:
    """Year first or day first, to ISO; else blank."""
    ymd, dmy = r"([0-9]{4})[/-]([0-9]{1,2})[/-]([0-9]{1,2})", r"([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})"
    part = lambda p, i: F.regexp_extract(c, p, i)
    return F.when(c.rlike(ymd), _iso(part(ymd, 1), part(ymd, 2), part(ymd, 3))).when(c.rlike(dmy), _iso(part(dmy, 3), part(dmy, 2), part(dmy, 1))).otherwise("")


def name_words(c: Column) -> Column:
    words = F.split(F.regexp_replace(F.upper(fold(F.coalesce(c, F.lit("")))), "[^A-Z0-9 ]", " "), " +")
    return F.array_distinct(F.array_except(F.filter(words, lambda w: F.length(w) >= 3), F.array(*map(F.lit, GENERIC))))


def same_party(a: Column, b: Column) -> Column:
    """Half of the shorter name's telling words, rounded up, must be shared."""
    return shares_words(name_words(a), name_words(b))


def shares_words(x: Column, y: Column) -> Column:
    need = F.greatest(F.lit(1), F.floor((F.least(F.size(x), F.size(y)) + 1) / 2))
    return (F.size(x) > 0) & (F.size(y) > 0) & (F.size(F.array_intersect(x, y)) >= need)


def differing(a: Column, b: Column) -> Column:
    """Places at which two texts of one length differ; 99 for other lengths."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1))
    return F.when(F.length(a) == F.length(b), F.aggregate(pairs, F.lit(0), lambda s, x: s + x)).otherwise(99)


def has_word(text: Column, word: str) -> Column:
    """The phrase stands between non-word characters. The pattern is tried only where the phrase is found at all."""
    import re

    return F.contains(text, F.lit(word)) & text.rlike(rf"(?U)(?<!\w){re.escape(word)}(?!\w)")


def spelled_out(c: Column) -> Column:
    """Six tokens or more, three fifths of them of one or two characters: a stamp read letter by letter."""
    t = F.filter(F.split(F.trim(c), r"\s+"), lambda x: ~x.isin("", "|", "_", "|_"))
    return (F.size(t) >= 6) & (F.size(F.filter(t, lambda x: F.length(x) <= 2)) >= 0.6 * F.size(t))


# Words of a pasted table's head.
TABLE_WORDS = ["FECHA", "FACTURA", "FACT", "CANTIDAD", "VALOR", "TOTAL", "NOMBRES", "APELLIDOS", "DETALLE", "UND", "UNITARIO", "DESCRIPCION", "ITEM"]


def party_name(c: Column) -> Column:
    """A line that looks like a company's name: 3 to 90 characters, no digit, dollar or colon at its end, four letters, nine tenths upper case, and no two words of a table's head."""
    t = F.trim(c)
    letters = F.length(F.regexp_replace(t, r"(?U)[^\p{L}]", ""))
    upper = F.length(F.regexp_replace(t, r"(?U)[^\p{Lu}]", ""))
    words = F.split(F.regexp_replace(F.upper(fold(t)), "[^A-Z ]", " "), " +")
    of_table = F.size(F.array_intersect(words, F.array(*map(F.lit, TABLE_WORDS)))) >= 2
    return F.length(t).between(3, 90) & ~t.rlike(r"[0-9$]") & ~t.endswith(":") & (letters >= 4) & ~of_table & (upper >= 0.9 * letters)


def qr_fields(c: Column) -> Column:
    """key:value or key=value pairs of a QR text as a map with lower-case keys; of repeated keys the first counts."""
    text = F.regexp_replace(c, r"[^\x20-\x7E\n¡-ÿ]", "")
    keys = F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z][A-Za-z0-9_ ]*?)\s*[:=]\s*([^\n;|]+)"), F.lit(1)), lambda k: F.lower(F.trim(k)))
    values = F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z][A-Za-z0-9_ ]*?)\s*[:=]\s*([^\n;|]+)"), F.lit(2)), lambda v: F.trim(v))
    once = F.array_distinct(keys)
    return F.map_from_arrays(once, F.transform(once, lambda k: F.get(values, F.array_position(keys, k).cast("int") - 1)))


def invoice_hash(c: Column) -> Column:
    """The 96-digit hash of an e-invoice: after its label, in a document URL, or alone."""
    found = [F.nullif(F.lower(F.regexp_extract(c, p, 1)), F.lit("")) for p in (r"(?i)cu(?:fe|de|ds)\s*[:=]?\s*([0-9a-f]{96})", r"(?i)(?:catalogo-vpfe|documentkey=)\S*?([0-9a-f]{96})", r"(?i)\b([0-9a-f]{96})\b")]
    return F.coalesce(*found)


def safe_name(c: Column) -> Column:
    """A file name without path or odd characters; without a suffix it gets .pdf."""
    base = F.regexp_replace(F.regexp_extract(F.coalesce(c, F.lit("")), r"([^/\\]*)$", 1), r"[^A-Za-z0-9._-]+", "_")
    base = F.btrim(base, F.lit("._"))
    base = F.when(base == "", "documento").otherwise(base)
    return F.when(base.rlike(r"\.[A-Za-z0-9]{2,5}$"), base).otherwise(F.concat(base, F.lit(".pdf")))


def pack_factor(c: Column) -> Column:
    """How many units a pack of the description holds, if more than one."""
    t = fold(c)
    n = F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in (r"(?:x|por)\s*([0-9]{1,4})\s*(?:und|unid|rollos?|pz|u)\b", r"\b([0-9]{1,4})\s*(?:rollos?|und|unidades|piezas|pz)\b")]).try_cast("int")
    return F.when(n > 1, n)


def let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used, inside functions over arrays, too."""
    return F.get(F.transform(F.array(value), use), 0)


def spots(text: Column, pattern: Column) -> Column:
    """Matches of a pattern with the number of characters before each: the text is cut at its matches."""
    length = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + F.length(x))
    cut = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("pieces"))
    place = lambda v, i: length(F.slice(v["pieces"], F.lit(1), i + 1)) + length(F.slice(v["hits"], F.lit(1), i))
    return let(cut, lambda v: F.transform(v["hits"], lambda h, i: F.struct(h.alias("hit"), place(v, i).alias("place"))))


def column_field(title: Column) -> Column:
    """The field that a column's normalised title names, blank if none. Titles may be misread; two titles share "documento", so "tipo" tells them apart."""
    says = lambda word: tolerant(title).contains(word.translate(str.maketrans("l105", "iios")))
    out = F.when(F.trim(title).isin("#", "n", "no"), "nro").when(says("documento"), F.when(says("tipo"), "document_kind").otherwise("document"))
    for word, field in COLUMN_WORDS.items():
        out = out.when(says(word), field)
    return out.otherwise("")


def screen_noise(c: Column) -> Column:
    """Buttons and bubbles of the portal that are read as if they were data."""
    return F.btrim(normalise(c), F.lit("?¿ ")).rlike(r"^(?:cambiar|ayuda|necesitas)\z|necesitas ayuda")


def invoice_references(c: Column) -> Column:
    """All numbers of two digits or more in a payment's reference."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[0-9]{2,}"), F.lit(0))


def payee_name(c: Column, noise: list[str] = FORM_WORDS) -> Column:
    """Words of letters that aren't noise. One letter alone counts only as a link (y, e) between two words of the name."""
    token = "[A-Za-zÁÉÍÓÚÑáéíóúñ][A-Za-zÁÉÍÓÚÑáéíóúñ&']*"
    link = lambda w: fold(w).isin("y", "e")
    takes = lambda kept, w: ~fold(w).isin(*noise) & F.when(F.length(w) == 1, link(w) & (F.size(kept) > 0)).otherwise(True)
    words = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(token), F.lit(0))
    kept = F.aggregate(words, F.array().cast("array<string>"), lambda kept, w: F.when(takes(kept, w), F.array_append(kept, w)).otherwise(kept))
    last = F.aggregate(F.transform(kept, lambda w, i: F.when(link(w), 0).otherwise(i + 1)), F.lit(0), lambda a, b: F.greatest(a, b))  # links at the end go
    return F.array_join(F.slice(kept, F.lit(1), last), " ")
