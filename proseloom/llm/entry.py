"""The queries of this package and their SQL, for __spark_entry__.py."""

from . import jaccard, linededup, media, packing, quality, spm, topk, toxicity, urlfilter, warc

QUERIES = {
    "op1_exact_topk": topk.op1,
    "op2_url_filter": urlfilter.op2,
    "op3_media_chunks": media.op3,
    "op4_toxicity": toxicity.op4,
    "op5_warc": warc.op5,
    "op6_quality": quality.op6,
    "op7_line_dedup": linededup.op7,
    "op8_ngram_jaccard": jaccard.op8,
    "op9_sentencepiece": spm.op9,
    "op10_best_fit_packing": packing.op10,
}
SQL = {
    "op1_exact_topk": topk.SQL,
    "op2_url_filter": urlfilter.SQL,
    "op5_warc": warc.SQL,
    "op7_line_dedup": linededup.SQL,
}
