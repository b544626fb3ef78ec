"""Expressions over names and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def email_folder(email: Column) -> Column:
    """A folder name for an address; null if nothing or more than 128 characters remain."""
    name = F.regexp_replace(F.replace(F.replace(F.lower(F.trim(email)), F.lit("@"), F.lit("_at_")), F.lit("."), F.lit("_")), r"[^a-z0-9_-]", "")
    return F.when((F.length(name) > 0) & (F.length(name) <= 128), name)


def valid_name(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[A-Za-z0-9_-]+$") & (F.length(name) <= 128), F.lit(False))


def variant_base(name: Column) -> Column:
    return F.regexp_replace(name, r"_v\d+$", "")


def variant_index(name: Column) -> Column:
    return F.coalesce(F.regexp_extract(name, r"_v(\d+)$", 1).try_cast("int"), F.lit(0))


def client_address(real: Column, forwarded: Column, remote: Column) -> Column:
    """The proxy's header, else the last of the forwarding list, else the peer."""
    filled = lambda x: F.when(F.trim(x) != "", F.trim(x))
    return F.coalesce(filled(real), filled(F.element_at(F.split(forwarded, ","), -1)), filled(remote), F.lit("unknown"))


def label_name(name: Column, label: Column) -> Column:
    """The first that is not empty of a feature's name and label."""
    filled = lambda x: F.nullif(x.cast("string"), F.lit(""))
    return F.coalesce(filled(name), filled(label), F.lit("Imported"))


def csv_field(x: Column) -> Column:
    """A value as a CSV field, quoted only where it has to be."""
    text = F.coalesce(x.cast("string"), F.lit(""))
    return F.when(text.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def xml_text(x: Column) -> Column:
    out = F.coalesce(x.cast("string"), F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def kml_colour(css: Column, alpha: str = "ff") -> Column:
    """#rrggbb as opacity, blue, green and red."""
    return F.concat(F.lit(alpha), F.substring(css, 6, 2), F.substring(css, 4, 2), F.substring(css, 2, 2))
