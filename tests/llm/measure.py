"""Measures what the README says of results: python tests/llm/measure.py [folder of tables].

Near-duplicates: of all pairs of an id divisible by 50 and any other document whose sets of five-word shingles have a
plain Jaccard similarity of 0.8 or more (found by brute force over an inverted index), the share that has one class.
Quality and language: accuracy on the rows that were not learned from.
"""

import os
import re
import sys
from collections import Counter, defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {hash(tuple(w[i : i + 5])) for i in range(len(w) - 4)} if len(w) >= 5 else {hash(tuple(w))} if w else set()


def main(folder="/root/testdata/sf0.1"):
    from pyspark.sql import SparkSession

    import __spark_entry__

    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries = __spark_entry__.queries()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    classes = {r.doc_id: r.class_id for r in queries["op5_near_duplicates"](spark, folder).collect()}
    sets = {r.doc_id: shingles(r.text) for r in docs.select("doc_id", "text").toLocalIterator()}
    having = defaultdict(list)
    for i, s in sets.items():
        for h in s:
            having[h].append(i)
    pairs = caught = 0
    for i in (i for i in sets if i % 50 == 0):
        for j, n in Counter(j for h in sets[i] for j in having[h] if j != i).items():
            if n / (len(sets[i]) + len(sets[j]) - n) >= 0.8:
                pairs, caught = pairs + 1, caught + (classes[i] == classes[j])
    print(f"near-duplicates: {caught} of {pairs} pairs at 0.8 share a class")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    q = queries["op4_quality"](spark, folder).where("held_out").join(labels, "doc_id").selectExpr("count(*) n", "count_if(predicted = quality) ok").first()
    print(f"quality: {q.ok} of {q.n} held-out labels")
    lang = queries["op9_language_id"](spark, folder).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'").selectExpr("count(*) n", "count_if(lang_pred = lang) ok").first()
    print(f"language: {lang.ok} of {lang.n} held-out documents")
    lm = queries["op7_language_model"](spark, folder).groupBy("held_out").agg({"score": "sum", "base_score": "sum", "n_tokens": "sum"}).collect()
    for r in lm:
        print(f"language model, held out {r.held_out}: perplexity {10 ** (-r['sum(score)'] / r['sum(n_tokens)']):.1f}, of the base {10 ** (-r['sum(base_score)'] / r['sum(n_tokens)']):.1f}")


if __name__ == "__main__":
    main(*sys.argv[1:])
