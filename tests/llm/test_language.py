"""Rejection by distance: texts in scripts or languages that weren't learned go, clean ones of any length stay."""

import base64
import random
from pathlib import Path

import pytest

from textloom.llm import language
from textloom.llm.common import id_remainder

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="test tables are not here")
FINNISH = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä"


def unlearned() -> dict[str, str]:
    rng = random.Random(5)

    def words(letters) -> str:
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(200))

    return {
        "latin": words("abcdefghijklmnopqrstuvwxyz"),
        "cyrillic": words("абвгдежзиклмнопрстуфхцчшыья"),
        "greek": words("αβγδεζηθικλμνξοπρστυφχψω"),
        "chinese": words([chr(c) for c in range(0x4E00, 0x5200)]),
        "base64": " ".join(base64.b64encode(rng.randbytes(9)).decode() for _ in range(200)),
        "hex": " ".join(rng.randbytes(8).hex() for _ in range(200)),
        "finnish": FINNISH,
    }


@needs_data
def test_unlearned_texts_are_rejected(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    model = language.train(language.training_rows(docs))
    odd = unlearned()
    assert {name for name, found in zip(odd, model.predict(list(odd.values())), strict=True) if not found[3]} == set()


@needs_data
def test_clean_texts_are_kept(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    model = language.train(language.training_rows(docs))
    held = docs.where(id_remainder("doc_id", 4) == 2).collect()
    lettered = [r for r in held if r.text and any(map(str.isalpha, r.text))]
    assert sum(found[3] for found in model.predict([r.text for r in lettered])) <= 0.03 * len(lettered)
    starts = [" ".join(r.text.split()[:n]) for r in lettered for n in (5, 10)]
    starts = [text for text in starts if any(map(str.isalpha, text))]
    assert sum(found[3] for found in model.predict(starts)) <= 0.03 * len(starts)
