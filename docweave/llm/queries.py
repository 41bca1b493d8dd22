"""The queries of this subpackage, by name, and the SQL that gives the same rows where SQL can."""

from docweave.llm.decontamination import OP8_SQL, op8_decontaminate
from docweave.llm.licenses import op6_licenses
from docweave.llm.manifest import OP11_SQL, op11_merkle_manifest
from docweave.llm.mixing import OP7_SQL, op7_mix_sources
from docweave.llm.neardup import op1_near_duplicates
from docweave.llm.pages import op3_main_text
from docweave.llm.quality import OP9_SQL, op9_quality
from docweave.llm.repeats import op4_repeats
from docweave.llm.secrets import op2_secrets
from docweave.llm.sharding import op10_shards
from docweave.llm.token_files import op13_token_files
from docweave.llm.warc import OP5_SQL, op5_warc
from docweave.llm.whitening import op12_whitening

QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_secrets": op2_secrets,
    "op3_main_text": op3_main_text,
    "op4_repeats": op4_repeats,
    "op5_warc": op5_warc,
    "op6_licenses": op6_licenses,
    "op7_mix_sources": op7_mix_sources,
    "op8_decontaminate": op8_decontaminate,
    "op9_quality": op9_quality,
    "op10_shards": op10_shards,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_whitening": op12_whitening,
    "op13_token_files": op13_token_files,
}

ORACLES = {
    "op5_warc": OP5_SQL,
    "op7_mix_sources": OP7_SQL,
    "op8_decontaminate": OP8_SQL,
    "op9_quality": OP9_SQL,
    "op11_merkle_manifest": OP11_SQL,
}
