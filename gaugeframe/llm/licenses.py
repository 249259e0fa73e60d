"""Licence scan: canonical digests of whole texts, and of single lines, looked up among known licences.

A text is brought to a canonical form - lower case, copyright lines dropped,
runs of letters and digits of any script as words, equivalent spellings
unified, one space between words, and a holder's name left out where texts have a place for one - and its SHA-256 is hash-joined
to the digests of the known texts. These are the complete texts of
``license_texts`` beside this module, each with and without its title and with
and without what follows its terms, and the one-line ``NOTICES``; the list is
fixed, so the broadcast side has a proven size. ``notices`` lists the one-line
notices that a text holds as whole lines, by the same digest.

A copyright line names a year, a sign or a placeholder at its beginning, ends in a year or in 'authors', or is just 'all rights
reserved': a wrapped line of a licence that begins with the word stays. Null
and empty texts, and texts without words, have the digest of the empty text and
no licence; repeated rows are each looked up; a text of any length is read
whole; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The published list of words that licence matching treats as the same, each with the word that stands for both.
SAME = {
    "acknowledgement": "acknowledgment", "acknowledgements": "acknowledgments", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations",
    "catalogue": "catalog", "categorise": "categorize", "centre": "center", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite",
    "fulfil": "fulfill", "fulfilment": "fulfillment", "https": "http", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling",
    "labour": "labor", "licence": "license", "licenced": "licensed", "licences": "licenses", "maximise": "maximize", "modelled": "modeled",
    "modelling": "modeling", "offence": "offense", "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice",
    "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling", "sublicence": "sublicense", "utilisation": "utilization",
    "whilst": "while", "wilful": "willful", "wilfull": "willful", "noncommercial": "non commercial", "noninfringement": "non infringement", "percent": "per cent",
}
#: The same of several words, on a text of words with one space between.
PHRASES = {"sub license": "sublicense", "sub licensed": "sublicensed", "copyright owner": "copyright holder", "copyright owners": "copyright holders"}
#: Where a text of words names its holder. What may stand there is left out.
HOLDERS = [
    (r"neither the name of .{1,200}? nor the names of (?:its|their) contributors", "neither the name of nor the names of its contributors"),
    (r"this software is provided by .{1,200}? as is and", "this software is provided by as is and"),
    (r"in no event shall .{1,200}? be liable", "in no event shall be liable"),
]
#: One-line notices. A notice names a licence and is not its text.
NOTICES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-notice": "Released under the MIT License.",
}
#: Titles that stand above texts which have none of their own.
TITLES = {
    "0BSD": ["Zero-Clause BSD", "BSD Zero Clause License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License"],
    "ISC": ["ISC License", "The ISC License"],
    "MIT": ["The MIT License", "The MIT License (MIT)"],
    "Zlib": ["zlib License", "The zlib/libpng License"],
}
#: Lines that name a holder, and not the licence; on a lower-cased text.
COPYRIGHT = (
    r"(?m)^[^a-z0-9\n]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4}|<|\[)|\(c\)[ \t]*(?:copyright|[0-9]{4}|<|\[)|©)[^\n]*$|^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$"
    r"|^[^a-z0-9\n]*copyright[ \t][^\n]*[0-9]{4}[^a-z0-9\n]*$|^[^a-z0-9\n]*copyright[ \t][^\n]*[ \t]authors[^a-z0-9\n]*$"
)
DROP, WORD = re.compile(COPYRIGHT), re.compile(r"[^\W_]+")


FIND = [(re.compile(p), w) for p, w in HOLDERS]


def words_of(low: str) -> str:
    """Words with equivalent spellings unified and holders left out."""
    out = f" {' '.join([SAME.get(w, w) for w in WORD.findall(low)])} "
    for a, b in PHRASES.items():
        out = out.replace(f" {a} ", f" {b} ")
    for pattern, with_ in FIND:
        out = pattern.sub(with_, out)
    return out[1:-1]


def canonical(text: str) -> str:
    low = text.lower()
    return words_of(DROP.sub("", low) if "copyright" in low or "(c)" in low or "©" in low or "all rights reserved" in low else low)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def variants(name: str, text: str) -> list[str]:
    """The text with and without its title, and with and without what follows its terms."""
    title, _, body = text.strip().partition("\n\n")
    short = len(title) < 200 and body
    out = [text, *([body] if short else []), *[f"{t}\n\n{body if short else text}" for t in TITLES.get(name, [])]]
    end = "END OF TERMS AND CONDITIONS"
    return out + [x.partition(end)[0] + tail for x in out if end in x for tail in ("", end)]


def known_texts() -> dict[str, str]:
    return {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def known_digests() -> list[tuple[str, str]]:
    out = {sha(canonical(x)): name for name, text in known_texts().items() for x in variants(name, text)}
    return sorted((out | notice_digests()).items())


def notice_digests() -> dict[str, str]:
    return {sha(canonical(t)): n for n, t in NOTICES.items()}


def scan(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """doc_id, canonical_sha256, license (of the whole text, else null), notices (sorted names of one-line notices)."""
    lines = notice_digests()

    def run(batches):
        for b in batches:
            digest, notices = [], []
            for text in b.column("text"):
                text = text.as_py() or ""
                digest.append(sha(canonical(text)))
                low = text.lower()
                held = {lines.get(sha(words_of(x))) for x in low.split("\n") if "license" in x or "licence" in x} if "licen" in low else set()
                notices.append(",".join(sorted(held - {None})))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(digest, pa.string()), pa.array(notices, pa.string())], ["doc_id", "canonical_sha256", "notices"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, canonical_sha256 string, notices string")
    table = spark.createDataFrame(known_digests(), "canonical_sha256 string, license string")
    return rows.join(F.broadcast(table), "canonical_sha256", "left").select("doc_id", "canonical_sha256", "license", "notices")


def oracle() -> str:
    """The same as DuckDB SQL."""
    same = " ".join(f"when '{a}' then '{b}'" for a, b in SAME.items())


    def digest(e: str) -> str:
        out = f"' ' || array_to_string(list_transform(regexp_extract_all({e}, '[\\p{{L}}\\p{{N}}]+'), lambda x: case x {same} else x end), ' ') || ' '"
        for a, b in PHRASES.items():
            out = f"replace({out}, ' {a} ', ' {b} ')"
        for pattern, with_ in HOLDERS:
            out = f"regexp_replace({out}, '{pattern}', '{with_}', 'g')"
        return f"sha256(coalesce(substring({out}, 2, length({out}) - 2), ''))"

    rows = ", ".join(f"('{d}', '{n}')" for d, n in known_digests())
    one = ", ".join(f"('{d}', '{n}')" for d, n in sorted(notice_digests().items()))
    return f"""
with d as (select doc_id, lower(coalesce(text, '')) as t from documents),
known(canonical_sha256, license) as (values {rows}), notice(h, name) as (values {one}),
lines as (select doc_id, unnest(string_split(t, chr(10))) as line from d),
n as (select doc_id, string_agg(distinct name, ',' order by name) as notices from (select doc_id, {digest("line")} as h from lines where regexp_matches(line, 'licen[sc]e')) join notice using (h) group by doc_id),
c as (select doc_id, {digest(f"regexp_replace(t, '{COPYRIGHT}', '', 'g')")} as canonical_sha256 from d)
select doc_id, canonical_sha256, license, coalesce(notices, '') as notices from c left join known using (canonical_sha256) left join n using (doc_id)"""
