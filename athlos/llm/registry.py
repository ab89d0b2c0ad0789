"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from . import (bpe, chat, classifier, line_dedup, minhash, quality_rules, sharding, suffix_dedup, token_counts, toxicity,
               vector_codes, whitening, wumanber)

QUERIES = {f.__name__: f for f in (line_dedup.op1_line_dedup, minhash.op2_minhash_dedup, bpe.op3_byte_bpe, suffix_dedup.op4_suffix_dedup,
                                   classifier.op5_quality_classifier, sharding.op6_sharding,
                                   wumanber.op7_decontamination, chat.op8_chat_format, token_counts.op9_token_counts,
                                   quality_rules.op10_quality_rules, line_dedup.op1_line_dedup_all_copies,
                                   vector_codes.op11_vector_codes, whitening.op12_embedding_whitening,
                                   toxicity.op13_toxicity)}
ORACLE = {"op1_line_dedup": line_dedup.SQL, "op2_minhash_dedup": minhash.SQL, "op7_decontamination": wumanber.SQL, "op8_chat_format": chat.SQL,
          "op10_quality_rules": quality_rules.SQL, "op1_line_dedup_all_copies": line_dedup.SQL,
          "op11_vector_codes": vector_codes.SQL}
