"""Queries of the llm operators and their SQL."""

from __future__ import annotations

from calibspark.llm import (decontaminate, licenses, mixing, ngram_lm, order_minhash, phrases, quality, repeats, token_counts,
                            toxicity, url_filter, warc, whitening)


def queries() -> dict:
    return {
        "op1_warc_segments": warc.op1_warc_segments,
        "op2_license_digests": licenses.op2_license_digests,
        "op3_toxicity_chain": toxicity.op3_toxicity_chain,
        "op4_order_minhash": order_minhash.op4_order_minhash,
        "op5_quality_rules": quality.op5_quality_rules,
        "op6_url_filter": url_filter.op6_url_filter,
        "op7_temperature_mix": mixing.op7_temperature_mix,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_repeated_passages": repeats.op10_repeated_passages,
        "op11_embedding_whitening": whitening.op11_embedding_whitening,
        "op12_phrase_collocations": phrases.op12_phrase_collocations,
        "op13_lm_scores": ngram_lm.op13_lm_scores,
    }


def oracle_sql() -> dict[str, str]:
    """The others have no SQL form (models, sketches, alignment, fingerprints,
    vocabulary splits, suffix arrays, eigenvectors) and are tested against brute force."""
    return {
        "op1_warc_segments": warc.oracle(),
        "op2_license_digests": licenses.oracle(),
        "op5_quality_rules": quality.oracle(),
        "op12_phrase_collocations": phrases.oracle(),
    }
