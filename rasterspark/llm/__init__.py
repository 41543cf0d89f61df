"""Operations of training-data pipelines. Nothing else in the package imports this subpackage.

``QUERIES`` and ``ORACLES`` hold its registered queries and their SQL twins.
"""

from rasterspark.llm.ann import op5_ann
from rasterspark.llm.bpe import op2_bpe
from rasterspark.llm.common import QueryFn
from rasterspark.llm.gif import op3_gif
from rasterspark.llm.merkle import ORACLE as _AUDIT
from rasterspark.llm.merkle import op4_merkle_audit
from rasterspark.llm.mixing import op7_pfair_mix
from rasterspark.llm.packing import op11_best_fit_packing
from rasterspark.llm.periodic_runs import op13_periodic_runs
from rasterspark.llm.quality import op1_quality
from rasterspark.llm.simhash import op9_simhash_dedup
from rasterspark.llm.spelling import ORACLE as _SPELLING
from rasterspark.llm.spelling import op12_spelling_variants
from rasterspark.llm.suffix_dedup import op8_suffix_dedup
from rasterspark.llm.unit_dedup import op10_substring_dedup
from rasterspark.llm.url_templates import ORACLE as _URLS
from rasterspark.llm.url_templates import op6_url_templates

QUERIES: dict[str, QueryFn] = {
    "op1_quality": op1_quality,
    "op2_bpe": op2_bpe,
    "op3_gif": op3_gif,
    "op4_merkle_audit": op4_merkle_audit,
    "op5_ann": op5_ann,
    "op6_url_templates": op6_url_templates,
    "op7_pfair_mix": op7_pfair_mix,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_simhash_dedup": op9_simhash_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES: dict[str, str] = {"op4_merkle_audit": _AUDIT, "op6_url_templates": _URLS, "op12_spelling_variants": _SPELLING}
