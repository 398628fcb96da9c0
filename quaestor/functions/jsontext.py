"""JSON in the answers of language models: fences fall away, and an object within other text is found."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def unfenced(text: Column) -> Column:
    """Text without a fence of three backticks around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?", ""), r"```$", ""))


def loaded(text: str | None) -> dict:
    """The object that the text is, else the first one that starts within it, else an empty one."""
    raw = re.sub(r"```$", "", re.sub(r"^```(?:json)?", "", (text or "").strip())).strip()
    try:
        whole = json.loads(raw)
        return whole if isinstance(whole, dict) else {}
    except ValueError:
        pass
    decode = json.JSONDecoder().raw_decode
    for m in re.finditer(r"\{", raw):
        try:
            return decode(raw, m.start())[0]
        except ValueError:
            continue
    return {}


def object_text(text: Column) -> Column:
    """The object as JSON text, `{}` where there is none. What is JSON as it stands never reaches Python."""

    @F.pandas_udf("string")
    def searched(texts):
        return texts.map(lambda t: json.dumps(loaded(t), ensure_ascii=False) if t is not None else None)

    plain = unfenced(text)
    fits = F.startswith(plain, F.lit("{")) & F.get_json_object(plain, "$").isNotNull()
    return F.coalesce(F.when(fits, plain), searched(F.when(~F.coalesce(fits, F.lit(False)), text)), F.lit("{}"))
