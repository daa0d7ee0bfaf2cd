"""Schemas of the data model; nothing is inferred in production."""

from __future__ import annotations

# The names and types of the fields that files of this data model have.
SECTION = "struct<head:string,n:string,text:string>"
PAPER = "arxiv_id string, tei string"
CHUNK = "arxiv_id string, chunk_idx int, text string, token_count int"
INDEX_ROW = "chunk_id string, arxiv_id string, chunk_idx int, text string, token_count int, embedding array<float>"
SEARCH_HIT = "chunk_id string, arxiv_id string, chunk_idx int, text string, score double"
ANNOTATION = "struct<unanswerable:boolean,yes_no:boolean,extractive_spans:array<string>,free_form_answer:string,evidence:array<string>,highlighted_evidence:array<string>>"
ANSWERS = f"array<struct<answer:{ANNOTATION}>>"
QUESTION_SET = f"map<string,struct<qas:array<struct<question:string,question_id:string,answers:{ANSWERS}>>>>"
REFERENCE = "struct<paperId:string,title:string,externalIds:map<string,string>>"
CITATION_RECORD = f"struct<paperId:string,title:string,externalIds:map<string,string>,references:array<{REFERENCE}>>"
RESPONSE_CACHE = "paper_id string, response_json string, fetched_at long"
PARSE_MANIFEST = "map<string,struct<download:string,size:long,error:string,grobid:string,title:string,num_sections:int,xml_size:int>>"
INDEX_MANIFEST = "map<string,struct<num_chunks:int,done:boolean>>"
SEED_MANIFEST = "struct<total_in_corpus:int,downloaded_this_run:array<string>,failed_this_run:array<string>,source:string>"
EVALUATION_ROW = (
    "question_id string, paper_id string, question string, gold_answers array<string>, gold_evidence array<string>, "
    "retrieved_chunk_ids array<string>, retrieved_arxiv_ids array<string>, recall_at_k double, predicted_answer string, "
    "answer_f1 double, latency_ms struct<retrieval:int,llm:int>"
)
NODES = "id string, in_corpus boolean"
EDGES = "src string, dst string"
SUMMARY_KEYS = ("tldr", "problem", "method", "results", "limitations")
