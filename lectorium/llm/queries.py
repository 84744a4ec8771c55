"""One query opN_<name> for each training-data operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from . import digest, licenses, packing, pieces, quality, replies, rules, search, secrets, simhash, tokenfile, trie, wrapper
from .common import table


def op1_pieces(spark, sf_dir):
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op2_quality(spark, sf_dir):
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_tokens(spark, sf_dir):
    return tokenfile.round_trip(table(spark, sf_dir, "documents"))


def op4_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_secrets(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_html(spark, sf_dir):
    return wrapper.main_text(table(spark, sf_dir, "pages"))


def op7_rules(spark, sf_dir):
    return rules.judged(table(spark, sf_dir, "documents"))


def op8_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_digest(spark, sf_dir):
    return digest.fingerprints(table(spark, sf_dir, "documents"))


def op11_search(spark, sf_dir):
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_replies(spark, sf_dir):
    return replies.digests(table(spark, sf_dir, "conversations"))


def op13_trie(spark, sf_dir):
    return trie.nodes(table(spark, sf_dir, "conversations"))


QUERIES = {"op1_pieces": op1_pieces, "op2_quality": op2_quality, "op3_tokens": op3_tokens, "op4_licenses": op4_licenses, "op5_secrets": op5_secrets, "op6_html": op6_html, "op7_rules": op7_rules, "op8_packing": op8_packing, "op9_simhash": op9_simhash, "op10_digest": op10_digest, "op11_search": op11_search, "op12_replies": op12_replies, "op13_trie": op13_trie}
ORACLES = {"op7_rules": rules.ORACLE_SQL, "op11_search": search.ORACLE_SQL, "op12_replies": replies.ORACLE_SQL, "op13_trie": trie.ORACLE_SQL}
