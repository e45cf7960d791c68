"""Rendered notes as PDF files, written by hand: text lines in the standard fonts, bold section heads, page after page.

The standard fonts hold Latin letters only. Marks that a note uses have a wording in them; any other letter outside is
shown as a question mark, so a note in another script should be printed from its rendered rows instead.
"""

from __future__ import annotations

import textwrap

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinispark.plans import render

WIDTH, HEIGHT, MARGIN, SIZE, LEAD = 595, 842, 56, 10, 14
COLUMNS = (WIDTH - 2 * MARGIN) * 2 // SIZE
#: Marks of a rendered note in letters that the standard fonts have.
MARKS = {render.MARK.strip(): "[!]", "\u2713": "yes", "\u2014": "-"}


def _text(line: str) -> bytes:
    for mark, plain in MARKS.items():
        line = line.replace(mark, plain)
    raw = line.encode("cp1252", "replace")
    return b"(" + raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"


def document(lines: list[tuple[bool, str]]) -> bytes:
    """A PDF file of (bold, text) lines, long ones wrapped."""
    wrapped = [(bold, part) for bold, line in lines for part in textwrap.wrap(line, COLUMNS) or [""]]
    each = (HEIGHT - 2 * MARGIN) // LEAD
    pages = [wrapped[i : i + each] for i in range(0, len(wrapped), each)] or [[]]
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", *[f"<< /Type /Font /Subtype /Type1 /BaseFont /{n} /Encoding /WinAnsiEncoding >>".encode() for n in ("Helvetica", "Helvetica-Bold")]]
    kids = []
    for page in pages:
        body = [b"BT", f"{LEAD} TL {MARGIN} {HEIGHT - MARGIN} Td".encode()]
        for bold, line in page:
            body += [f"/F{2 if bold else 1} {SIZE} Tf".encode(), _text(line) + b" Tj T*"]
        stream = b"\n".join([*body, b"ET"])
        objects.append(f"<< /Length {len(stream)} >>\nstream\n".encode() + stream + b"\nendstream")
        kids.append(len(objects) + 1)
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {WIDTH} {HEIGHT}] /Contents {len(objects)} 0 R /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>".encode())
    objects[1] = f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(f'{k} 0 R' for k in kids)}] >>".encode()
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, o in enumerate(objects, 1):
        places.append(len(out))
        out += f"{i} 0 obj\n".encode() + o + b"\nendobj\n"
    start = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010d} 00000 n \n".encode() for p in places)
    return bytes(out + f"trailer << /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{start}\n%%EOF\n".encode())


def files(rendered: DataFrame) -> DataFrame:
    """Rendered rows -> (note_id, name, pdf): one file a note, of a name that holds the note's id."""
    held = F.array_sort(F.collect_list(F.struct("section_no", "row_no", "section", F.array_join("cells", " | ").alias("line"))))

    def draw(frames):
        for f in frames:
            out = []
            for note, rows in zip(f["note_id"], f["rows"], strict=True):
                lines, last = [], None
                for r in rows:
                    if r["section_no"] and r["section_no"] != last:
                        lines += [(False, ""), (True, r["section"])]
                    lines.append((not r["section_no"], r["line"]))
                    last = r["section_no"]
                safe = "".join(c if c.isalnum() or c in "-_" else "_" for c in str(note))
                out.append((note, f"{safe}_draft_rx.pdf", document(lines)))
            yield pd.DataFrame(out, columns=["note_id", "name", "pdf"])

    by_note = rendered.groupBy("note_id").agg(held.alias("rows"))
    return by_note.mapInPandas(draw, f"note_id {rendered.schema['note_id'].dataType.simpleString()}, name string, pdf binary")


def save(found: DataFrame, folder: str) -> int:
    """Writes each PDF under folder, one at a time through the session's file systems; returns how many."""
    jvm, conf = found.sparkSession._jvm, found.sparkSession._jsc.hadoopConfiguration()
    n = 0
    for row in found.select("name", "pdf").toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(folder, row["name"])
        out = path.getFileSystem(conf).create(path, True)
        out.write(bytearray(row["pdf"]))
        out.close()
        n += 1
    return n
