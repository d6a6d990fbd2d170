"""The registered queries of this package and their SQL."""

from . import divergence, gif, html_text, language, mixing, packing, quality, secret_scan, simhash, spelling, spotsigs, suffix_dedup, url_filter

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_packing": packing.query,
    "op3_spotsigs": spotsigs.query,
    "op4_quality_classifier": quality.query,
    "op5_suffix_dedup": suffix_dedup.query,
    "op6_simhash": simhash.query,
    "op7_gif_media": gif.query,
    "op8_language_id": language.query,
    "op9_html_text": html_text.query,
    "op10_url_filter": url_filter.query,
    "op11_secret_scan": secret_scan.query,
    "op12_source_divergence": divergence.query,
    "op13_spelling_variants": spelling.query,
}
ORACLE = {
    "op1_mixing": mixing.ORACLE,
    "op2_packing": packing.ORACLE,
    "op3_spotsigs": spotsigs.ORACLE,
    "op5_suffix_dedup": suffix_dedup.ORACLE,
    "op10_url_filter": url_filter.ORACLE,
    "op11_secret_scan": secret_scan.ORACLE,
    "op12_source_divergence": divergence.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
