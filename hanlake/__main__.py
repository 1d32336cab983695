"""Commands over a folder of tables in Parquet: info, radical, components, readings, script, search, within, convert, list, build, install."""

from __future__ import annotations

import argparse
import sys
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates
from .operators import dictionary as dic
from .operators import gr
from .operators import readings as rd
from .operators import reports
from .operators.characters import CharacterLookup
from .plans import derive, sinks
from .plans.catalog import CHARACTER, Catalog
from .sources import dictionaries


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="hanlake", description=__doc__)
    p.add_argument("--tables", default="tables", help="folder of <Table>.parquet; more behind it, with : between")
    p.add_argument("--locale", default="T")
    p.add_argument("--domain", default="Unicode")
    p.add_argument("--limit", type=int, default=100)
    sub = p.add_subparsers(dest="command", required=True)
    for name, what in (("info", "all about characters"), ("components", "characters with all of these components"), ("list", "tables, domains and readings")):
        sub.add_parser(name, help=what).add_argument("text", nargs="?" if name == "list" else None)
    sub.add_parser("radical", help="characters of a radical by remaining strokes").add_argument("index", type=int)
    r = sub.add_parser("readings", help="readings of a text's characters")
    r.add_argument("reading")
    r.add_argument("text")
    s = sub.add_parser("script", help="simplified (S) or traditional (T) forms of a text")
    s.add_argument("kind", choices=["S", "T"])
    s.add_argument("text")
    d = sub.add_parser("search", help="dictionary entries by headword, reading or translation")
    d.add_argument("dictionary")
    d.add_argument("query")
    w = sub.add_parser("within", help="dictionary entries whose headword is any part of a text")
    w.add_argument("dictionary")
    w.add_argument("text")
    b = sub.add_parser("build", help="derived tables, or groups of them, from the folder's tables; without names a list of them")
    b.add_argument("names", nargs="*")
    b.add_argument("--rebuild", action="store_true")
    i = sub.add_parser("install", help="a dictionary's file as a table, unless this release is there")
    i.add_argument("dictionary")
    i.add_argument("path")
    i.add_argument("--released", help="its date, as written")
    c = sub.add_parser("convert", help="between two styles of a reading, or two readings; how the text is written is guessed unless said")
    c.add_argument("reading")
    c.add_argument("text")
    c.add_argument("--to", help="another reading, which the conversion goes to")
    c.add_argument("--source", nargs="*", default=[])
    c.add_argument("--target", nargs="*", default=[])
    return p


def _options(pairs: list[str]) -> dict:
    words = {"true": True, "false": False}
    return {k: words.get(v.lower(), v) for k, _, v in (x.partition("=") for x in pairs)}


def open_catalog(spark: SparkSession, folders: str) -> Catalog:
    def table(path: Path):
        return lambda: spark.read.parquet(str(path))

    return Catalog(*({p.stem: table(p) for p in sorted(Path(f).glob("*.parquet"))} for f in folders.split(":")))


#: Tables of syllables by reading, and of pairs of readings, as seeds name them.
PAIRS = {"WadeGilesPinyinMapping": ("WadeGiles", "Pinyin", rd.wade_giles_to_pinyin, rd.pinyin_to_wade_giles), "JyutpingYaleMapping": ("Jyutping", "CantoneseYale", rd.jyutping_to_yale, rd.yale_to_jyutping)}


def conversions(catalog: Catalog) -> rd.Conversions:
    """All conversions that a catalog's tables allow."""
    found = rd.Conversions()
    for name, table in ((n, catalog[n]) for n in catalog.names() if n.endswith("Syllables")):
        kind = name.removesuffix("Syllables")
        if kind in rd.READINGS and kind in table.columns:
            rd.register_inventory(kind, [r[0] for r in table.select(kind).collect()])
    for name, (a, b, there, back) in PAIRS.items():
        if name in catalog:
            columns = [c for c in (a, b, "PinyinIdx") if c in catalog[name].columns]
            rows = [tuple(r) for r in catalog[name].select(columns).collect()]
            found.publish(a, b, lambda x, y, rows=rows, make=there: make(rows, x, y))
            found.publish(b, a, lambda x, y, rows=rows, make=back: make(rows, x, y))
    if "PinyinIPAMapping" in catalog:
        rows = [tuple(r) for r in catalog["PinyinIPAMapping"].select("Pinyin", "IPA", "Feature").collect()]
        rd.register_inventory("MandarinIPA", [i for _, i, _ in rows])
        found.publish("Pinyin", "MandarinIPA", lambda x, y: rd.pinyin_to_ipa(rows, x, y))
    if "PinyinGRMapping" in catalog:
        rows = [tuple(r) for r in catalog["PinyinGRMapping"].select("Pinyin", "GR").collect()]
        rd.register_inventory("GR", [g for _, g in rows])
        found.publish("Pinyin", "GR", lambda x, y: gr.GRPinyin(rows, x, y))
        found.publish("GR", "Pinyin", lambda x, y: gr.GRPinyin(rows, x, y))
    return found


def standard_build(spark: SparkSession) -> derive.Build:
    """The derived tables that need only seeds and Unihan."""
    return derive.Build([
        derive.Builder("ComponentLookup", ("CharacterDecomposition",), derive.component_lookup),
        derive.Builder("CharacterVariant", ("Unihan",), derive.variants),
        derive.Builder("CharacterKangxiRadical", ("Unihan",), lambda wide: derive.radical_indices(wide, "kRSKangXi")),
        derive.Builder("Glyphs", ("CharacterDecomposition", "StrokeOrder", "Unihan"), derive.glyphs),
        derive.Builder("StrokeCount", ("StrokeOrder",), derive.stroke_counts),
        derive.Builder("GlyphInformationSet", ("StrokeOrder", "CharacterDecomposition"), derive.glyph_information_set),
        *(derive.Builder(f"{n}Set", ("Unihan",), lambda wide, n=n: derive.character_set(wide, n)) for n in [*derive.SET_COLUMNS, *derive.UNION_SETS]),
    ], {"strokes": ("StrokeCount", "Glyphs"), "sets": tuple(f"{n}Set" for n in derive.SET_COLUMNS), "all": ("strokes", "sets", "ComponentLookup", "CharacterVariant", "CharacterKangxiRadical")})


def run(args: argparse.Namespace, spark: SparkSession) -> DataFrame | list[str]:
    catalog = open_catalog(spark, args.tables)
    if args.command == "build":
        run_ = standard_build(spark)
        if not args.names:
            return [*(f"table {t}" for t in sorted(run_.builders)), *(f"group {g}" for g in sorted(run_.groups))]
        made = run_.run(catalog, args.names, args.rebuild)
        for name in made:
            sinks.write_table(catalog[name], args.tables.split(":")[0], name)
        return [f"built {name}" for name in made]
    if args.command == "install":
        released = spark.range(1).select(dates.release_date(F.lit(args.released))).first()[0] if args.released else None
        done = sinks.install(dictionaries.read_dictionary(spark, args.path, args.dictionary), args.tables.split(":")[0], args.dictionary, released)
        return [f"{args.dictionary} {'installed' if done else 'is up to date'}"]
    if args.command == "list":
        return [*(f"table {t}" for t in catalog.names()), *(f"domain {d}" for d in catalog.domains()), *(f"reading {r}" for r in sorted(rd.READINGS))]
    if args.command == "convert":
        name = f"{args.reading}Syllables"
        if name in catalog:
            rd.register_inventory(args.reading, [r[0] for r in catalog[name].select(args.reading).collect()])
        source = {k: v for k, v in rd.guess_dialect(args.reading, args.text).items() if k in rd.READINGS[args.reading].defaults} | _options(args.source)
        if args.to and args.to != args.reading:
            return [conversions(catalog).get(rd.reading(args.reading, **source), rd.reading(args.to, **_options(args.target))).convert(args.text)]
        made = rd.respelling(rd.reading(args.reading, **source), rd.reading(args.reading, **_options(args.target)))
        return [made.convert(args.text)]
    if args.command == "within":
        entries = catalog[args.dictionary]
        forms = [c for c in entries.columns if c.startswith("Headword")]
        return entries.where(reduce(Column.__or__, [dic.exact_multiple(c, args.text) for c in forms])).distinct()
    if args.command == "search":
        entries = catalog[args.dictionary]
        found = dic.Dictionary(entries, [c for c in entries.columns if c.startswith("Headword")], headword_search=dic.Wildcard(True), reading_search=dic.Wildcard(True))
        return found.get_for(args.query).limit(args.limit)
    look = CharacterLookup(catalog, args.locale, args.domain, ordered=True)
    if args.command == "radical":
        return reports.characters_by_residual(look, spark.range(1).select(F.lit(args.index).alias("RadicalIndex")), False)
    if args.command == "components":
        return look.characters_for_components([[c] for c in args.text])
    text = spark.range(1).select("id", F.lit(args.text).alias("text"))
    if args.command == "readings":
        return reports.readings_of_text(look, text, "text", args.reading).select("readings")
    if args.command == "script":
        return reports.convert_script(look, text, "text", args.kind).select("converted")
    chars = text.select(F.explode(F.array_distinct(F.split("text", ""))).alias(CHARACTER)).where(F.col(CHARACTER) != "")
    return reports.character_information(look, chars, [n.removeprefix("Character") for n in catalog.names() if n.startswith("Character") and "Reading" in catalog[n].columns])


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("hanlake").getOrCreate()
    found = run(args, spark)
    if isinstance(found, DataFrame):
        print("\t".join(found.columns), file=out)
        found = ["\t".join("" if x is None else " ".join(map(str, x)) if isinstance(x, list) else str(x) for x in row) for row in found.limit(args.limit).collect()]
    print("\n".join(found), file=out)


if __name__ == "__main__":
    main()
