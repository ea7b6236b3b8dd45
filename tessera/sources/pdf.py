"""PDF files as blocks of pages. Needs PyMuPDF on the executors; the rest of the engine works from the blocks, wherever they come from."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.settings import Settings

#: A page with less text than this and with images is one to recognise.
OCR_CHARS = 48
_BLOCKS = pa.schema(
    [("uri", pa.string()), ("page", pa.int32()), ("pages", pa.int32()), ("label", pa.string()), ("ord", pa.int32()), ("text", pa.string()), ("bbox", pa.list_(pa.float64())), ("font_size", pa.float64()),
     ("bold_ratio", pa.float64()), ("mono_ratio", pa.float64()), ("ocr", pa.bool_()), ("ocr_error", pa.string()), ("error", pa.string()), ("truncated_pages", pa.int32())]
)


def page_blocks(raw: dict) -> list[dict]:
    """The text blocks of a page in the library's dictionary form, with their font figures."""
    out = []
    for block in raw.get("blocks", []):
        spans = [s for line in block.get("lines", []) for s in line.get("spans", []) if s.get("text", "").strip()]
        text = "\n".join("".join(s.get("text", "") for s in line.get("spans", [])).rstrip() for line in block.get("lines", [])).strip()
        if not text or not spans:
            continue
        sizes = [len(s["text"]) for s in spans]
        total = sum(sizes)
        share = lambda test: sum(n for s, n in zip(spans, sizes, strict=True) if test(s)) / total  # noqa: B023, E731
        out.append(
            {
                "text": text, "bbox": [round(float(x), 2) for x in block.get("bbox", (0, 0, 0, 0))], "font_size": float(median(s.get("size", 0.0) for s in spans)),
                "bold_ratio": share(lambda s: "bold" in s.get("font", "").lower() or s.get("flags", 0) & 16), "mono_ratio": share(lambda s: any(x in s.get("font", "").lower() for x in ("mono", "courier", "consol")) or s.get("flags", 0) & 8),
            }
        )
    return out


def available() -> bool:
    try:
        import pymupdf  # noqa: F401
    except ImportError:
        return False
    return True


def page_tables(page) -> list[dict]:
    """The tables that the library finds on a page, as markdown blocks."""
    out = []
    for table in page.find_tables().tables:
        rows = [[" ".join((c or "").split()).replace("|", "\\|") for c in r] for r in table.extract()]
        width = max(map(len, rows), default=0)
        lines = ["| " + " | ".join([*r, *[""] * (width - len(r))]) + " |" for r in rows]
        if lines:
            lines.insert(1, "| " + " | ".join(["---"] * width) + " |")
            out.append({"text": "\n".join(lines), "bbox": [round(float(x), 2) for x in table.bbox], "font_size": 0.0, "bold_ratio": 0.0, "mono_ratio": 0.0})
    return out


def read_pdf_blocks(files: DataFrame, settings: Settings | None = None, ocr: str = "off") -> DataFrame:
    """Blocks of the PDF files in files (uri, content), a row each; a file that can't be read gives one row with its error. truncated_pages, the same in all
    rows of a file, are those that pdf_max_pages and pdf_max_chars left out, in whole or in part.

    ocr: off, auto (pages with images and hardly any text) or always; what fails is recorded in ocr_error.
    """
    settings = settings or Settings()

    def blocks_of(uri: str, content: bytes) -> list[dict]:
        import pymupdf

        out: list[dict] = []
        with pymupdf.open(stream=content, filetype="pdf") as pdf:
            chars, left_out = 0, max(0, len(pdf) - settings.pdf_max_pages)
            for number in range(min(len(pdf), settings.pdf_max_pages)):
                page, failed = pdf[number], ""
                text_page = None
                if ocr == "always" or ocr == "auto" and len(page.get_text().strip()) < OCR_CHARS and page.get_images():
                    try:
                        text_page = page.get_textpage_ocr()
                    except Exception as e:  # noqa: BLE001  the page keeps what text it has
                        failed = str(e)[:200]
                if chars > settings.pdf_max_chars:
                    break
                for i, block in enumerate(page_blocks(page.get_text("dict", textpage=text_page) if text_page else page.get_text("dict"))):
                    chars += len(block["text"])
                    if chars > settings.pdf_max_chars:
                        left_out = len(pdf) - number
                        break
                    out.append(block | {"uri": uri, "page": number + 1, "pages": len(pdf), "label": page.get_label() or str(number + 1), "ord": i, "ocr": text_page is not None, "ocr_error": failed, "error": ""})
        return [b | {"truncated_pages": left_out} for b in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    out = blocks_of(row["uri"], row["content"])
                except Exception as e:  # noqa: BLE001  one bad file must not end the job
                    out = [{"uri": row["uri"], "error": f"{type(e).__name__}: {e}"[:300]}]
                yield pa.RecordBatch.from_pylist(out, _BLOCKS)

    return files.select("uri", "content").mapInArrow(
        run, "uri string, page int, pages int, label string, ord int, text string, bbox array<double>, font_size double, bold_ratio double, mono_ratio double, ocr boolean, ocr_error string, error string, truncated_pages int"
    )
