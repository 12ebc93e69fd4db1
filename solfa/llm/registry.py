"""Queries of the training-data operators, by name, with DuckDB twins where SQL can express them."""

from .bit_sliced import OP6_SQL, op6_bit_sliced
from .bpe import op4_byte_bpe
from .collocations import OP12_SQL, op12_collocations
from .dominance import op11_dominance_packing
from .language import op1_language_id
from .line_dedup import op3_line_dedup
from .media import op10_media_columns
from .packing import op5_packing
from .simhash import op8_simhash
from .suffix_dedup import op2_suffix_dedup
from .token_counts import op7_token_counts
from .url_filter import OP9_SQL, op9_url_filter
from .whitening import op13_whitening

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_packing": op5_packing,
    "op6_bit_sliced": op6_bit_sliced,
    "op7_token_counts": op7_token_counts,
    "op8_simhash": op8_simhash,
    "op9_url_filter": op9_url_filter,
    "op10_media_columns": op10_media_columns,
    "op11_dominance_packing": op11_dominance_packing,
    "op12_collocations": op12_collocations,
    "op13_whitening": op13_whitening,
}
ORACLES: dict[str, str] = {"op6_bit_sliced": OP6_SQL, "op9_url_filter": OP9_SQL, "op12_collocations": OP12_SQL}
