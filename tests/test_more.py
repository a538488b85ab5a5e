"""Queries whose patterns SQL twins lack, against Python."""

import hashlib
import re

from conftest import DATA
from test_scripts import scanned

from strataforge import catalog


def test_doubled_vowels(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    for r in catalog.QUERIES["N7_doubled_vowels"](spark, DATA).collect():
        assert r["hash"] == hashlib.sha256(re.sub(r"([aeiou])\1+", r"\1", texts[r["doc_id"]].lower()).encode()).hexdigest()


def test_romanised(spark):
    """The query reads whole texts; a scanner that looks at one character after another reads the same."""
    letters = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ाबचदेफगहिजकलमनोपखरसतुवयषीझ")
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    for r in catalog.QUERIES["C15_romanise"](spark, DATA).collect():
        latin = scanned(texts[r["doc_id"]].lower().translate(letters))
        assert (r["length"], r["hash"]) == (len(latin), hashlib.sha256(latin.encode()).hexdigest())
