"""The queries of this subpackage.  Each is held against a brute-force version or a round trip in tests/llm."""

from factweave.llm import periodic_runs, vector_codes
from factweave.llm.bpe_coding import op12_bpe_coding
from factweave.llm.cotraining import op6_cotraining_quality
from factweave.llm.epsilon_join import op5_epsilon_grid_join
from factweave.llm.jaccard_join import op3_ngram_jaccard_join
from factweave.llm.language_crf import op7_language_crf
from factweave.llm.nn_descent import op2_nn_descent
from factweave.llm.packing import op8_sum_of_squares_packing
from factweave.llm.periodic_runs import op11_periodic_runs
from factweave.llm.piece_sampling import op10_ffbs_pieces
from factweave.llm.pseudonyms import op9_feistel_pseudonyms
from factweave.llm.suffix_dedup import op1_suffix_dedup
from factweave.llm.vector_codes import op13_vector_codes
from factweave.llm.warc_derivatives import op4_warc_derivatives

QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_nn_descent, op3_ngram_jaccard_join, op4_warc_derivatives, op5_epsilon_grid_join,
        op6_cotraining_quality, op7_language_crf, op8_sum_of_squares_packing, op9_feistel_pseudonyms, op10_ffbs_pieces,
        op11_periodic_runs, op12_bpe_coding, op13_vector_codes,
    )
}
ORACLE_SQL: dict[str, str] = {"op11_periodic_runs": periodic_runs.ORACLE, "op13_vector_codes": vector_codes.oracle()}
