"""Fake values drawn from a keyed hash: equal input, equal fake, on every run.

All values come from the 32 hex digits of an MD5 over seed and source value, so
they need neither state nor a shuffle and any task can compute them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dictionaries the fakes are picked from.
FIRST_NAMES = (
    "Ada", "Amir", "Bea", "Carl", "Dina", "Elio", "Fern", "Gita", "Hugo", "Ines",
    "Jack", "Kira", "Luis", "Mona", "Nils", "Olga", "Paul", "Rosa", "Sven", "Tara",
)
LAST_NAMES = (
    "Adler", "Brook", "Costa", "Dietz", "Ebner", "Frost", "Grant", "Huber", "Ibsen", "Jones",
    "Keller", "Lopez", "Meyer", "North", "Olsen", "Price", "Quinn", "Reed", "Stone", "Young",
)
STREETS = (
    "Ash Lane", "Birch Road", "Cedar Street", "Dale Avenue", "Elm Street", "Forest Way",
    "Garden Row", "Hill Road", "Island View", "Juniper Close", "King Street", "Lake Drive",
    "Mill Lane", "North Road", "Oak Avenue", "Park Street",
)
CITIES = (
    "Ashford", "Brookfield", "Clearwater", "Dunmore", "Eastport", "Fairview", "Glenwood",
    "Harborne", "Ironside", "Kingsley", "Lakewood", "Milton", "Newbridge", "Oakham",
    "Pinehurst", "Riverton",
)
COUNTRIES = (
    "Argentina", "Austria", "Brazil", "Canada", "Chile", "Denmark", "Egypt", "Finland",
    "France", "Germany", "India", "Italy", "Japan", "Kenya", "Mexico", "Norway",
    "Peru", "Poland", "Spain", "Sweden",
)
COMPANIES = (
    "Acorn", "Beacon", "Cobalt", "Delta", "Ember", "Falcon", "Granite", "Harbor",
    "Iris", "Jasper", "Kestrel", "Lumen", "Meridian", "Nimbus", "Orchid", "Pioneer",
)
COMPANY_FORMS = ("Ltd", "Inc", "Group", "Partners", "Works", "Labs")
WORDS = (
    "amber", "basin", "cloud", "dune", "ember", "field", "grove", "hollow", "island", "jetty",
    "kettle", "lantern", "meadow", "needle", "orchard", "pebble", "quarry", "river", "saddle",
    "timber", "upland", "valley", "willow", "yonder",
)
SEPARATOR = "\x1f"
EMAIL_DOMAIN = "example.com"
NUMBER_RANGE = (0, 1_000_000)
SENTENCE_WORDS = (3, 10)
CHARACTERS_PER_WORD = 6
RECENT_FROM = "2026-01-01 00:00:00"
RECENT_SECONDS = 86_400


def digest(domain: tuple[str, ...], text: Column) -> Column:
    """Hash of the text within a domain; the hash of null, and every fake, is null."""
    prefix = "".join(part + SEPARATOR for part in domain)
    return F.md5(F.concat(F.lit(prefix), text))


def hex_number(hash_text: Column, start: int, digits: int = 8) -> Column:
    """Hex digits of the hash, from 1-based ``start``, as a number."""
    return F.conv(F.substring(hash_text, start, digits), 16, 10).cast("bigint")


def below(hash_text: Column, start: int, size: int | Column, digits: int = 8) -> Column:
    return F.pmod(hex_number(hash_text, start, digits), size if isinstance(size, Column) else F.lit(size))


def pick(values: tuple[str, ...], hash_text: Column, start: int) -> Column:
    # get(), as element_at() reads the last entry where the index is null.
    return F.get(F.array(*[F.lit(v) for v in values]), below(hash_text, start, len(values)).cast("int"))


def _joined(separator: str, *parts: Column) -> Column:
    """Parts with a separator between them, null if any part is."""
    spread = [piece for part in parts for piece in (F.lit(separator), part)]
    return F.concat(*spread[1:])


def first_name(h: Column) -> Column:
    return pick(FIRST_NAMES, h, 1)


def last_name(h: Column) -> Column:
    return pick(LAST_NAMES, h, 9)


def full_name(h: Column) -> Column:
    return _joined(" ", first_name(h), last_name(h))


def email(h: Column) -> Column:
    """The last eight digits of the hash keep addresses of different people apart."""
    local = F.lower(_joined(".", first_name(h), last_name(h), F.substring(h, 25, 8)))
    return F.concat(local, F.lit("@" + EMAIL_DOMAIN))


def phone(h: Column) -> Column:
    def digits(start: int, width: int) -> Column:
        return F.lpad(below(h, start, 10**width).cast("string"), width, "0")

    return F.concat(F.lit("+1-555-"), digits(1, 3), F.lit("-"), digits(9, 4), F.lit("-"), digits(17, 4))


def street_address(h: Column) -> Column:
    return _joined(" ", (below(h, 1, 999) + 1).cast("string"), pick(STREETS, h, 9))


def city(h: Column) -> Column:
    return pick(CITIES, h, 1)


def country(h: Column) -> Column:
    return pick(COUNTRIES, h, 1)


def company(h: Column) -> Column:
    return _joined(" ", pick(COMPANIES, h, 1), pick(COMPANY_FORMS, h, 9), F.substring(h, 25, 8))


def uuid(h: Column) -> Column:
    """Version 4 shape: the version and variant digits are fixed, the rest is the hash."""
    variant = F.substring(F.lit("89ab"), (below(h, 17, 4, digits=1) + 1).cast("int"), F.lit(1))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3),
        F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )


def number(h: Column, low: int = NUMBER_RANGE[0], high: int = NUMBER_RANGE[1]) -> Column:
    """Whole number from ``low`` to ``high``, both included."""
    return F.lit(low).cast("bigint") + below(h, 1, high - low + 1, digits=15)


def amount(h: Column, low: float, high: float) -> Column:
    """Money amount with two decimals."""
    cents = number(h, round(low * 100), round(high * 100))
    return (cents.cast("decimal(20,0)") / F.lit(100)).cast("decimal(10,2)")


def word(h: Column) -> Column:
    return pick(WORDS, h, 1)


def _words(h: Column, count: Column) -> Column:
    def nth(i: Column) -> Column:
        return pick(WORDS, F.md5(F.concat(h, i.cast("string"))), 1)

    return F.array_join(F.transform(F.sequence(F.lit(1), count.cast("int")), nth), " ")


def _as_sentence(words: Column) -> Column:
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1_000_000), F.lit("."))


def sentence(h: Column, max_length: int | None = None) -> Column:
    """Sentence of three words or more, cut to ``max_length`` characters."""
    least, most = SENTENCE_WORDS
    if max_length is not None:
        most = max(least, -(-max_length // CHARACTERS_PER_WORD))
    text = _as_sentence(_words(h, below(h, 1, most - least + 1) + least))
    return text if max_length is None else F.substring(text, 1, max_length)


def two_sentences(h: Column) -> Column:
    return _joined(" ", sentence(F.md5(F.concat(h, F.lit("a")))), sentence(F.md5(F.concat(h, F.lit("b")))))


def zip_code(h: Column) -> Column:
    return F.lpad(below(h, 1, 100_000).cast("string"), 5, "0")


def url(h: Column) -> Column:
    return F.concat(F.lit("https://"), word(h), F.lit("-"), F.substring(h, 25, 8), F.lit(".example.com/"))


def boolean(h: Column) -> Column:
    return below(h, 1, 2) == 1


def instant(h: Column, start: str, seconds: int) -> Column:
    """Timestamp without zone, a whole second from ``start`` on."""
    return F.timestamp_add("SECOND", below(h, 1, seconds), F.lit(start).cast("timestamp_ntz"))


def recent_instant(h: Column) -> Column:
    return instant(h, RECENT_FROM, RECENT_SECONDS)


def choice(h: Column, values: tuple[str, ...]) -> Column:
    return pick(values, h, 1)


FAKES: dict[str, Callable[[Column], Column]] = {
    "faker:name": full_name,
    "faker:firstName": first_name,
    "faker:lastName": last_name,
    "faker:email": email,
    "faker:phone": phone,
    "faker:address": street_address,
    "faker:city": city,
    "faker:country": country,
    "faker:company": company,
    "faker:uuid": uuid,
}
