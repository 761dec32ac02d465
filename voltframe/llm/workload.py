"""The registered queries of the text operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voltframe.llm import exact_dedup, fim, lexical, line_dedup, vafile
from voltframe.llm.exact_dedup import op9_exact_dedup
from voltframe.llm.fim import op13_fill_in_middle
from voltframe.llm.langid import op5_language_crf
from voltframe.llm.lexical import op12_ranked_search
from voltframe.llm.line_dedup import op2_line_spread
from voltframe.llm.packing import op10_best_fit_packing
from voltframe.llm.pii import op1_feistel_pseudonyms
from voltframe.llm.sampling import op3_sampled_segmentations
from voltframe.llm.simhash import op4_simhash
from voltframe.llm.sketches import op7_bottom_k
from voltframe.llm.token_counts import op8_token_counts
from voltframe.llm.toxicity import op6_toxicity
from voltframe.llm.vafile import op11_exact_top_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_feistel_pseudonyms,
        op2_line_spread,
        op3_sampled_segmentations,
        op4_simhash,
        op5_language_crf,
        op6_toxicity,
        op7_bottom_k,
        op8_token_counts,
        op9_exact_dedup,
        op10_best_fit_packing,
        op11_exact_top_k,
        op12_ranked_search,
        op13_fill_in_middle,
    )
}
ORACLE: dict[str, str] = {
    "op2_line_spread": line_dedup.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
    "op11_exact_top_k": vafile.SQL,
    "op12_ranked_search": lexical.SQL,
    "op13_fill_in_middle": fim.SQL,
}
