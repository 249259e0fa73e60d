"""Tasks: source row to sample, sample to prompt, answer to prediction. All are Column expressions."""

from __future__ import annotations

import base64
import importlib
import pkgutil
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsers, text

# Prompt formats.
DOC_CONTEXT = "Based on the following document text, answer the question accurately and concisely.\n\nDocument text:\n{context}\n\nQuestion: {question}\n\nAnswer:"
DOC_QUESTION = "Answer the following question:\n\nQuestion: {question}\n\nAnswer:"
TABLE_QUESTION = "Based on the following table, answer the question accurately.\n\nTable:\n{table}\n\nQuestion: {question}\n\nAnswer:"
TABLE_HTML = "Given the following table cell contents in row-major order, generate a valid HTML table with proper <table>, <tr>, and <td> tags.\n\nTable cells:\n{table_text}\n\nGenerate the HTML table structure. Respond with ONLY the HTML code, no explanation:"
PASSAGE_KO = "다음 지문을 읽고 질문에 답하세요. 답변은 지문에서 나타나는 정답만 간결하게 기술하세요.\n\n지문:\n{context}\n\n질문: {question}\n\n답변:"
SUMMARY_KO = "다음 문서에 대한 간결한 요약을 생성하세요. 요약은 원문의 핵심 내용을 2-3문장으로 정리해야 합니다.\n\n문서:\n{document}\n\n요약:"
SUMMARY = "Generate a concise summary of the following document. The summary should capture the key points in 2-3 sentences.\n\nDocument:\n{document}\n\nSummary:"
SENTIMENT = 'Classify the sentiment of the following text as exactly one word: "positive" or "negative".\n\nText: {text}\n\nRespond with exactly one word: positive or negative'
KEYPHRASES = "Extract the key phrases or keywords from the following academic document. List them as a comma-separated list with no additional text.\n\nTitle and Abstract:\n{document}\n\nKey phrases (comma-separated):"
MODERATION = 'You are a content moderation classifier. Analyze the following text and determine if it contains profanity, hate speech, or toxic language. Respond with exactly one word: "toxic" or "clean".\n\nText: {text}\n\nRespond with exactly one word: toxic or clean'
CAPTION = "Describe this image in one sentence."
TAGS = "List the main objects visible in this image as a comma-separated list of simple nouns."
WEAPON = "Does this image contain a weapon or threat (gun, knife, pistol, rifle, blood, etc.)? Answer exactly yes or no."
NSFW = "You are a content-safety classifier. Does this image contain adult/NSFW (sexually explicit) content? Answer exactly 'nsfw' or 'safe'."
PERSON = "Is there a person visible in this image? Answer exactly yes or no."
# Object classes. Class ids of weapons; names of the 1-based category ids, which have a gap at 12.
WEAPON_IDS = [3, 4, 6, 7, 8, 9, 10, 12, 13, 14, 19, 23, 24, 25, 26, 28]
CATEGORIES = {
    1: "person", 2: "bicycle", 3: "car", 4: "motorcycle", 5: "airplane", 6: "bus", 7: "train", 8: "truck", 9: "boat", 10: "traffic light",
    11: "fire hydrant", 13: "stop sign", 14: "parking meter", 15: "bench", 16: "cat", 17: "dog", 18: "horse", 19: "sheep", 20: "cow", 21: "elephant",
    22: "bear", 23: "zebra", 24: "giraffe", 25: "backpack", 26: "umbrella", 27: "handbag", 28: "tie", 29: "suitcase", 30: "frisbee", 31: "skis",
    32: "snowboard", 33: "sports ball", 34: "kite", 35: "baseball bat", 36: "baseball glove", 37: "skateboard", 38: "surfboard", 39: "tennis racket",
    40: "bottle", 41: "wine glass", 42: "cup", 43: "fork", 44: "knife", 45: "spoon", 46: "bowl", 47: "banana", 48: "apple", 49: "sandwich",
    50: "orange", 51: "broccoli", 52: "carrot", 53: "hot dog", 54: "pizza", 55: "donut", 56: "cake", 57: "chair", 58: "couch", 59: "potted plant",
    60: "bed", 61: "dining table", 62: "toilet", 63: "tv", 64: "laptop", 65: "mouse", 66: "remote", 67: "keyboard", 68: "microwave", 69: "oven",
    70: "toaster", 71: "sink", 72: "refrigerator", 73: "book", 74: "clock", 75: "vase", 76: "scissors", 77: "teddy bear", 78: "hair drier", 79: "toothbrush",
}


def fill(template: str, **values: Column) -> Column:
    """The template with its {names} replaced by columns."""
    parts: list[Column] = []
    for i, piece in enumerate(template.replace("}", "{").split("{")):
        parts.append(F.coalesce(values[piece], F.lit("")) if i % 2 else F.lit(piece))
    return F.concat(*parts)


def first_present(df: DataFrame, names: list[str]) -> Column:
    """The first of these columns that the frame has and that is neither null nor empty in the row."""
    have = [c for c in names if c in df.columns]
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in have]) if have else F.lit(None).cast("string")


def table_markdown(header: Column, rows: Column) -> Column:
    """Markdown of a header and rows; rows are padded and cut to the header's width."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    width = F.size(header)
    fit = lambda r: F.slice(F.concat(F.transform(r, lambda v: F.coalesce(v, F.lit("None"))), F.array_repeat(F.lit(""), width)), F.lit(1), width)
    body = F.transform(rows, lambda r: line(fit(r)))
    text_ = F.array_join(F.concat(F.array(line(header)), F.array(line(F.array_repeat(F.lit("---"), width))), body), "\n")
    return F.when(F.coalesce(width, F.lit(0)) < 1, "").otherwise(text_)


def grid_text(cells: Column) -> Column:
    """Cells as bracketed rows up to the last row and column, empty ones included.

    Cells come row by row and in the order of their columns, as parsers.table_cells gives them; of cells of one place the last counts.
    The text is built in one pass: each cell adds the breaks and the empty places since the one before, and the last column is known beforehand.
    """
    width = F.array_max(F.transform(cells, lambda x: x["c"]))
    blank = lambda n: F.repeat(F.lit(" []"), F.greatest(n, F.lit(0)).cast("int"))
    # what comes between one cell and the next: places left in the row, whole empty rows, places before the cell
    rest = lambda c: blank(width - c)
    empty = F.concat(F.lit("\n[]"), blank(width))
    lead = lambda c: F.when(c == 0, F.lit("")).otherwise(F.concat(F.lit("[]"), blank(c - 1), F.lit(" ")))
    nxt = F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0)))
    last = F.arrays_zip(cells.alias("x"), F.concat(nxt, F.array(F.lit(None).cast(_CELL))).alias("y"))

    def piece(z: Column) -> Column:
        x, y = z["x"], z["y"]
        here = F.concat(F.lit("["), F.coalesce(x["txt"], F.lit("")), F.lit("]"))
        same_row = F.concat(F.lit(" "), F.regexp_replace(blank(y["c"] - x["c"] - 1), r"^ (.*)$", "$1 "))
        new_row = F.concat(rest(x["c"]), F.repeat(empty, F.greatest(y["r"] - x["r"] - 1, F.lit(0))), F.lit("\n"), lead(y["c"]))
        return F.when(y.isNull(), F.concat(here, rest(x["c"]))).when((y["r"] == x["r"]) & (y["c"] == x["c"]), "").when(y["r"] == x["r"], F.concat(here, same_row)).otherwise(F.concat(here, new_row))

    first = F.get(cells, F.lit(0))
    head = F.concat(F.repeat(F.concat(F.lit("[]"), blank(width), F.lit("\n")), first["r"]), lead(first["c"]))
    return F.when(F.size(cells) < 1, "").otherwise(F.concat(head, F.array_join(F.transform(last, piece), "")))


_CELL = "struct<r:int,c:int,txt:string>"


def document_cut(c: Column) -> Column:
    return F.substring(c, 1, 6000)


def category_tags(ids: Column, names: Column | None = None) -> Column:
    """Distinct names of object ids: by position in names where given, else by the fixed map."""
    if names is not None:
        found = F.transform(ids, lambda i: F.when(i >= 0, F.get(names, i)))
    else:
        table = F.create_map(*[x for k, v in CATEGORIES.items() for x in (F.lit(k), F.lit(v))])
        found = F.transform(ids, lambda i: F.try_element_at(table, i))
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def is_weapon(ids: Column) -> Column:
    return F.exists(ids, lambda i: i.isin(WEAPON_IDS)).cast("int")


def is_person(ids: Column) -> Column:
    return F.array_contains(ids, 0).cast("int")


@dataclass(frozen=True)
class Task:
    """A task: prompt(columns of a sample by name) and parse(answer)."""

    task_id: str
    kind: str
    prompt: Callable[[dict[str, Column]], Column]
    parse: Callable[[Column], Column]
    is_vision: bool = False
    sensitive: bool = False
    meta: dict = field(default_factory=dict)


REGISTRY: dict[str, Task] = {}


def register(task: Task) -> Task:
    """Adds a task, or replaces the one of its id."""
    REGISTRY[task.task_id] = task
    return task


def discover(package: str) -> dict[str, str]:
    """Imports every module of a package, whose tasks register themselves; name -> message of the modules that fail, which are left out."""
    found = importlib.import_module(package)
    failed = {}
    for m in sorted(pkgutil.iter_modules(found.__path__), key=lambda m: m.name):
        name = f"{package}.{m.name}"
        try:
            importlib.import_module(name)
        except Exception as e:  # one module must not keep the others out
            failed[name] = f"{type(e).__name__}: {e}"
    return failed


def _doc_prompt(c):
    return F.when(c["context"].isNotNull() & (c["context"] != ""), fill(DOC_CONTEXT, **c)).otherwise(fill(DOC_QUESTION, question=c["question"]))


def _summary_prompt(c):
    return F.when(c["lang"] == "ko", fill(SUMMARY_KO, document=c["document"])).otherwise(fill(SUMMARY, document=c["document"]))


def _simple(template: str):
    return lambda c: fill(template, **{k: v for k, v in c.items() if "{" + k + "}" in template})


for _t in (
    Task("IMG-1", "generation", _simple(CAPTION), parsers.stripped, True),
    Task("IMG-2", "multilabel", _simple(TAGS), parsers.tags, True),
    Task("IMG-3", "binary", _simple(WEAPON), parsers.weapon, True),
    Task("IMG-4", "binary", _simple(NSFW), parsers.nsfw, True, True),
    Task("IMG-5", "binary", _simple(PERSON), parsers.person, True),
    Task("TXT-1", "qa", _doc_prompt, parsers.stripped),
    Task("TXT-2", "qa", _simple(TABLE_QUESTION), parsers.stripped),
    Task("TXT-3", "extraction", _simple(TABLE_HTML), parsers.table_or_text),
    Task("TXT-4", "qa", _simple(PASSAGE_KO), parsers.stripped),
    Task("TXT-5", "generation", _summary_prompt, parsers.stripped),
    Task("TXT-6", "classification", _simple(SENTIMENT), parsers.sentiment),
    Task("TXT-7", "multilabel", _simple(KEYPHRASES), parsers.keyphrases),
    Task("TXT-8", "binary", _simple(MODERATION), parsers.toxicity),
):
    register(_t)


def samples_qa(rows: DataFrame, task_id: str) -> DataFrame:
    """TXT-1 and TXT-4: question, context (OCR words joined, or a passage), answers as references."""
    words = F.array_join("words", " ") if "words" in rows.columns else F.lit(None).cast("string")
    context = F.coalesce(words, first_present(rows, ["context"]))
    answers = F.col("answers") if dict(rows.dtypes)["answers"].startswith("array") else F.array(F.col("answers").cast("string"))
    return rows.select(F.lit(task_id).alias("task_id"), "sample_id", F.lit("ko" if task_id == "TXT-4" else "en").alias("lang"), "question", context.alias("context"), answers.alias("ref_text"))


def samples_table_qa(rows: DataFrame) -> DataFrame:
    """TXT-2: the markdown of the table, ready or rendered."""
    ready = F.nullif(F.col("table_md"), F.lit("")) if "table_md" in rows.columns else F.lit(None).cast("string")
    made = table_markdown(F.col("table.header"), F.col("table.rows")) if "table" in rows.columns else F.lit("")
    return rows.select(F.lit("TXT-2").alias("task_id"), "sample_id", F.lit("en").alias("lang"), F.coalesce(ready, made, F.lit("")).alias("table"), "question", F.col("answers").alias("ref_text"))


def samples_table(rows: DataFrame) -> DataFrame:
    """TXT-3: rows whose HTML has cells, with their grid as text."""
    html = first_present(rows, ["html_table", "html", "table", "content"])
    cells = rows.select("sample_id", html.alias("ref_html")).withColumn("cells", parsers.table_cells(F.col("ref_html"))).where(F.size("cells") > 0)
    return cells.select(F.lit("TXT-3").alias("task_id"), "sample_id", F.lit("en").alias("lang"), grid_text(F.col("cells")).alias("table_text"), "ref_html", "cells")


def samples_summary(rows: DataFrame) -> DataFrame:
    """TXT-5: article cut to 6000 characters, and its summary (a list joined by spaces)."""
    names = [c for c in ("summary", "highlights", "summary_text", "target") if c in rows.columns]
    one = [F.array_join(c, " ") if dict(rows.dtypes)[c].startswith("array") else F.col(c) for c in names]
    return rows.select(F.lit("TXT-5").alias("task_id"), "sample_id", "lang", document_cut(first_present(rows, ["article", "document", "text", "content"])).alias("document"), F.array(F.coalesce(*one)).alias("ref_text"))


def samples_labelled(rows: DataFrame, task_id: str, texts: list[str], labels: list[str]) -> DataFrame:
    """TXT-6 and TXT-8: rows with both a text and a label."""
    have = [F.col(c).cast("int") for c in labels if c in rows.columns]
    out = rows.select(F.lit(task_id).alias("task_id"), "sample_id", "lang", first_present(rows, texts).alias("text"), F.coalesce(*have).alias("ref_label"))
    return out.where("text is not null and ref_label is not null")


def samples_keyphrase(rows: DataFrame) -> DataFrame:
    """TXT-7: title, blank line, abstract; distinct normalised key phrases; rows without either are left out."""
    keys = F.col("keywords")
    listed = F.array_distinct(F.filter(F.transform(keys, text.normalize), lambda x: x != "")) if dict(rows.dtypes)["keywords"].startswith("array") else parsers.keyphrase_list(keys)
    doc = text.py_strip(F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("abstract", F.lit(""))))
    out = rows.select(F.lit("TXT-7").alias("task_id"), "sample_id", F.lit("en").alias("lang"), doc.alias("document"), listed.alias("ref_set"))
    return out.where((F.col("document") != "") & (F.size("ref_set") > 0))


def samples_objects(rows: DataFrame, task_id: str) -> DataFrame:
    """IMG-2, IMG-3, IMG-5 from object categories: names (rows without any are left out), weapon or person label."""
    ids = F.col("objects.category")
    base = [F.lit(task_id).alias("task_id"), F.col("sample_id"), F.lit("en").alias("lang")]
    if task_id == "IMG-2":
        return rows.select(*base, category_tags(ids).alias("ref_set")).where(F.size("ref_set") > 0)
    return rows.select(*base, (is_weapon(ids) if task_id == "IMG-3" else is_person(ids)).alias("ref_label"))


def samples_caption(rows: DataFrame) -> DataFrame:
    """IMG-1: captions as references; sample ids keep the source's numbering."""
    return rows.select(F.lit("IMG-1").alias("task_id"), "sample_id", F.lit("en").alias("lang"), "url", F.col("sentences").alias("ref_text"))


def messages(prompt: Column, image_url: Column | None = None) -> Column:
    """The chat messages of a prompt: array<struct<role, content: array<struct<type, text, url>>>>."""
    part = lambda kind, t, u: F.struct(F.lit(kind).alias("type"), t.cast("string").alias("text"), u.cast("string").alias("url"))
    null = F.lit(None)
    parts = [part("text", prompt, null)] if image_url is None else [part("image_url", null, image_url), part("text", prompt, null)]
    return F.array(F.struct(F.lit("user").alias("role"), F.array(*parts).alias("content")))


def data_url(content: Column, mime: str = "image/jpeg") -> Column:
    # base64 breaks its lines, a URL has none
    return F.concat(F.lit(f"data:{mime};base64,"), F.regexp_replace(F.base64(content), "[\r\n]+", ""))


def probe_image(side: int = 8, rgb: tuple[int, int, int] = (255, 0, 0)) -> str:
    """A data URL of a small PNG of one colour, to find out whether an endpoint takes images."""

    def part(tag: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    line = bytes([0, *rgb * side])  # a line begins with its filter: none
    head = struct.pack(">2I5B", side, side, 8, 2, 0, 0, 0)
    png = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(line * side)) + part(b"IEND", b"")
    return f"data:image/png;base64,{base64.b64encode(png).decode()}"
