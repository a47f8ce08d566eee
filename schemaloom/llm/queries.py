"""The queries of the corpus operators, and SQL for those that SQL can express."""

from .bpe import op9_byte_bpe
from .decontam import op3_decontamination
from .language import op6_language
from .lines import OP10_SQL, op10_line_dedup
from .neardup import op5_near_dedup
from .quality import op2_host_quality
from .ranked import OP13_SQL, op13_ranked_search
from .secrets import op1_secret_scan
from .suffix import op7_suffix_dedup
from .toxicity import op4_toxicity
from .urls import op11_url_filter
from .warc import OP8_SQL, op8_warc_revisits
from .whitening import op12_whitening

QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_host_quality, op3_decontamination, op4_toxicity, op5_near_dedup, op6_language, op7_suffix_dedup, op8_warc_revisits, op9_byte_bpe, op10_line_dedup, op11_url_filter, op12_whitening, op13_ranked_search)}
SQL = {"op8_warc_revisits": OP8_SQL, "op10_line_dedup": OP10_SQL, "op13_ranked_search": OP13_SQL}
