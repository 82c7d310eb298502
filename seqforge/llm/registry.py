"""The queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from . import chat, collocations, decontaminate, images, jaccard, licences, packing, phrases, quality, rankbpe, ranked, secrets, sql, tokenfile


def queries() -> dict:
    return {
        "op1_chat_formatting": chat.op1_chat_formatting,
        "op2_best_fit_packing": packing.op2_best_fit_packing,
        "op3_ngram_jaccard_join": jaccard.op3_ngram_jaccard_join,
        "op4_image_copies": images.op4_image_copies,
        "op5_quality_classifier": quality.op5_quality_classifier,
        "op6_benchmark_decontamination": decontaminate.op6_benchmark_decontamination,
        "op7_secret_scan": secrets.op7_secret_scan,
        "op8_license_scan": licences.op8_license_scan,
        "op9_substring_dedup": phrases.op9_substring_dedup,
        "op10_token_id_files": tokenfile.op10_token_id_files,
        "op11_byte_bpe": rankbpe.op11_byte_bpe,
        "op12_phrase_collocations": collocations.op12_phrase_collocations,
        "op13_ranked_search": ranked.op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_ngram_jaccard_join": sql.OP3_SQL,
        "op6_benchmark_decontamination": decontaminate.OP6_SQL,
        "op9_substring_dedup": sql.OP9_SQL,
        "op12_phrase_collocations": collocations.OP12_SQL,
        "op13_ranked_search": ranked.OP13_SQL,
    }
