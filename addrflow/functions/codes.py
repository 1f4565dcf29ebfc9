"""Registry codes, hashes and keys as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of localities and their codes.
LOCALITY_KINDS = {"czescMiejscowosci": 0, "czescMiejcowosci": 0, "wies": 1, "kolonia": 2, "przysiolek": 3, "osada": 4, "osadaLesna": 5, "osiedle": 6, "schroniskoTurystyczne": 7, "dzielnicaWarszawy": 95, "miasto": 96, "delegatura": 98, "czescMiasta": 99}
#: Kinds of street objects and the street kind of each.
OBJECT_KINDS = {"ulica": "ul.", "aleja": "al.", "plac": "pl.", "skwer": "skwer", "bulwar": "bulw.", "rondo": "rondo", "park": "park", "rynek": "rynek", "szosa": "szosa", "droga": "droga", "osiedle": "os.", "ogrod": "ogr.", "wyspa": "wyspa", "wybrzeze": "wyb.", "wawoz": "wawoz", "innyLiniowy": "", "innyPowierzchniowy": ""}


def recode(c: Column, values: dict) -> Column:
    """The value for a word of a small dictionary, null for other words (M7)."""
    return F.try_element_at(F.create_map(*(F.lit(x) for x in chain.from_iterable(values.items()))), c)


def pad(c: Column, n: int) -> Column:
    """Zeros before a code; longer codes are left as they are."""
    return F.lpad(c, F.greatest(F.lit(n), F.length(c)), F.lit("0"))


def build_terc(woj: Column, pow_: Column, gmi: Column, rodz: Column) -> Column:
    """struct(terc, parent, level) of a unit: the level is that of the last part given."""
    parts = [F.nullif(F.trim(c), F.lit("")) for c in (woj, pow_, gmi, rodz)]
    w, p, g = (F.coalesce(pad(c, 2), F.lit("00")) for c in parts[:3])
    terc = F.concat(w, p, g, F.coalesce(parts[3], F.lit("0")))
    level = F.when(parts[2].isNotNull(), 3).when(parts[1].isNotNull(), 2).otherwise(1)
    parent = F.when(level == 3, F.concat(w, p, F.lit("000"))).when(level == 2, F.concat(w, F.lit("00000")))
    return F.struct(terc.alias("terc"), parent.alias("parent_terc"), level.alias("level"))


def deepest_unit(codes: Column) -> Column:
    """The longest code of two to seven digits in an array (M6)."""
    fit = F.filter(codes, lambda x: F.rlike(x, F.lit("^[0-9]{2,7}$")))
    return F.array_max(F.transform(fit, lambda x: F.struct(F.length(x).alias("n"), x.alias("code"))))["code"]


def point_hash(*parts: Column | str) -> Column:
    """SHA-256 of the fields that make a point what it is; missing ones count as empty."""
    return F.sha2(F.concat_ws("\u0001", *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts)), 256)


def coordinate_text(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%.6f", c))


def match_key_simc(simc: Column, street_norm: Column, number_key: Column) -> Column:
    """Key of an address by locality code."""
    return F.when(simc.isNotNull(), F.concat_ws("|", F.lit("s"), simc, F.coalesce(street_norm, F.lit("")), number_key))


def match_key_name(locality_norm: Column, street_norm: Column, number_key: Column) -> Column:
    """Key of an address by locality name."""
    return F.when(locality_norm.isNotNull(), F.concat_ws("|", F.lit("n"), locality_norm, F.coalesce(street_norm, F.lit("")), number_key))


def billing_units(route: Column, items: Column, batch_route: str = "/v1/batch") -> Column:
    """Units of a request: the number of items of a batch, else one."""
    return F.when(route == batch_route, F.greatest(F.coalesce(items, F.lit(0)), F.lit(1))).otherwise(1)


def billing_period(ts: Column) -> Column:
    return F.to_date(F.date_trunc("month", ts))


def key_checksum(secret: Column) -> Column:
    """First six characters of the base64url form of the secret's CRC-32."""
    crc = F.lpad(F.hex(F.crc32(secret.cast("binary"))), 8, "0")
    return F.substring(F.translate(F.base64(F.unhex(crc)), "+/", "-_"), 1, 6)


def api_key_parts(key: Column, live: str = "adr_live_", test: str = "adr_test_", secret_chars: int = 32) -> Column:
    """struct(environment, secret) of a well-formed key with a right checksum, else null."""
    shape = rf"^(?:({live})|({test}))([A-Za-z0-9_-]{{{secret_chars}}})_([A-Za-z0-9_-]{{6}})$"
    secret = F.regexp_extract(key, shape, 3)
    kind = F.when(F.regexp_extract(key, shape, 1) != "", "live").otherwise("test")
    return F.when((secret != "") & (key_checksum(secret) == F.regexp_extract(key, shape, 4)), F.struct(kind.alias("environment"), secret.alias("secret")))


def address_lines(kind: Column, street: Column, number: Column, flat: Column, postal: Column, locality: Column) -> Column:
    """The two lines of a postal address."""
    n = F.concat_ws("/", F.nullif(number, F.lit("")), F.nullif(flat, F.lit("")))
    road = F.concat_ws(" ", F.nullif(kind, F.lit("")), F.nullif(street, F.lit("")))
    first = F.trim(F.concat_ws(" ", F.when(road != "", road).otherwise(F.coalesce(locality, F.lit(""))), n))
    return F.filter(F.array(first, F.concat_ws(" ", F.nullif(postal, F.lit("")), F.nullif(locality, F.lit("")))), lambda x: x != "")
