"""Queries of the corpus operators, by name, and their SQL where SQL expresses them."""

from waybill.llm.chat import OP1_SQL, op1_chat
from waybill.llm.decontaminate import OP7_SQL, op7_decontaminate
from waybill.llm.fim import OP11_SQL, op11_fim
from waybill.llm.langid import op6_language
from waybill.llm.licenses import op3_licenses
from waybill.llm.mixing import OP9_SQL, op9_mixing
from waybill.llm.ngram_join import op4_ngram_join
from waybill.llm.pii import op13_pii
from waybill.llm.quality import op8_quality
from waybill.llm.resampling import OP12_SQL, op12_resample
from waybill.llm.sharding import op2_sharding
from waybill.llm.toxicity import op10_toxicity
from waybill.llm.vector_dedup import op5_vector_dedup


def queries():
    return {
        "op1_chat": op1_chat,
        "op2_sharding": op2_sharding,
        "op3_licenses": op3_licenses,
        "op4_ngram_join": op4_ngram_join,
        "op5_vector_dedup": op5_vector_dedup,
        "op6_language": op6_language,
        "op7_decontaminate": op7_decontaminate,
        "op8_quality": op8_quality,
        "op9_mixing": op9_mixing,
        "op10_toxicity": op10_toxicity,
        "op11_fim": op11_fim,
        "op12_resample": op12_resample,
        "op13_pii": op13_pii,
    }


def oracle_sql():
    return {"op1_chat": OP1_SQL, "op7_decontaminate": OP7_SQL, "op9_mixing": OP9_SQL, "op11_fim": OP11_SQL, "op12_resample": OP12_SQL}
