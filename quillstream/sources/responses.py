"""Answers of the full-text reader and of the scorer, as columns. The calls themselves are injected."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstream.functions.text import content_hash, normalize_full_text

READER = "struct<status:string,output:array<struct<type:string,status:string,content:array<struct<type:string,text:string>>>>>"
PAGE = "struct<success:boolean,full_text:string,final_url:string,failure_reason:string>"
SCORER = "struct<choices:array<struct<finish_reason:string,message:struct<content:string>>>,usage:struct<prompt_tokens:int,completion_tokens:int>>"


def unfenced(text: Column) -> Column:
    """The text within one code fence, if it is fenced."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def read_reader(raw: Column) -> Column:
    """struct(full_text, final_url, content_hash, content_chars, failure_kind): a completed search call, the last text
    block, success, and a text that is not blank; else failure_kind says what lacks."""
    r = F.from_json(raw, READER)
    searched = F.exists(r["output"], lambda o: (o["type"] == "web_search_call") & (o["status"] == "completed"))
    texts = F.flatten(F.transform(F.filter(r["output"], lambda o: o["type"] == "message"), lambda o: F.filter(o["content"], lambda c: c["type"] == "output_text")))
    page = F.from_json(unfenced(F.try_element_at(texts, F.lit(-1))["text"]), PAGE)
    text = normalize_full_text(page["full_text"])
    kind = (
        F.when(r.isNull() | r["output"].isNull(), "invalid_response")
        .when(r["status"] != "completed", "incomplete_response")
        .when(~F.coalesce(searched, F.lit(False)), "search_not_used")
        .when(page.isNull() | page["success"].isNull(), "invalid_json")
        .when(~page["success"], "not_found")
        .when(F.coalesce(text, F.lit("")) == "", "empty_content")
    )
    ok = kind.isNull()
    return F.struct(F.when(ok, text).alias("full_text"), F.when(ok, page["final_url"]).alias("final_url"), F.when(ok, content_hash(text)).alias("content_hash"), F.when(ok, F.length(text)).alias("content_chars"), kind.alias("failure_kind"))


def read_scorer(raw: Column) -> Column:
    """struct(data: the answer's JSON object as text, prompt_tokens, completion_tokens, error): an answer cut by its length
    or that is no object is an error; tokens default to 0."""
    r = F.from_json(raw, SCORER)
    first = F.try_element_at(r["choices"], F.lit(1))
    text = unfenced(first["message"]["content"])
    error = F.when(first.isNull(), "invalid_response").when(first["finish_reason"] == "length", "length").when(~F.coalesce(text.rlike(r"(?s)^\{.*\}$") & F.try_parse_json(text).isNotNull(), F.lit(False)), "invalid_json")
    tokens = lambda n: F.coalesce(r["usage"][n], F.lit(0))
    return F.struct(F.when(error.isNull(), text).alias("data"), tokens("prompt_tokens").alias("prompt_tokens"), tokens("completion_tokens").alias("completion_tokens"), error.alias("error"))
