"""Operators for preparing language-model training data."""


def queries() -> dict:
    from .bpe import op8_bpe
    from .decontaminate import op7_decontamination
    from .divergence import op11_source_divergence
    from .html_text import op10_html_text
    from .katz import op4_katz
    from .minhash import op1_minhash
    from .pii import op5_surrogates
    from .ppm import op6_language_id
    from .repetition import op9_repetition
    from .token_counts import op3_token_counts
    from .url_filter import op13_url_filter
    from .variants import op12_spelling_variants
    from .warc import op2_warc

    return {
        "op1_minhash": op1_minhash,
        "op2_warc": op2_warc,
        "op3_token_counts": op3_token_counts,
        "op4_katz": op4_katz,
        "op5_surrogates": op5_surrogates,
        "op6_language_id": op6_language_id,
        "op7_decontamination": op7_decontamination,
        "op8_bpe": op8_bpe,
        "op9_repetition": op9_repetition,
        "op10_html_text": op10_html_text,
        "op11_source_divergence": op11_source_divergence,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_url_filter": op13_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    from .divergence import OP11_SQL
    from .url_filter import OP13_SQL
    from .variants import OP12_SQL

    return {"op11_source_divergence": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_url_filter": OP13_SQL}
