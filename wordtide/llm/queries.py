"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from wordtide.llm import chat, chosen_path, fertility, html_text, latent, licences, pieces, shards, toxicity, wavelet

QUERIES = {
    "op1_latent_decontamination": latent.query,
    "op2_template_removal": html_text.query,
    "op3_external_shuffle": shards.query,
    "op4_toxic_segments": toxicity.query,
    "op5_tokeniser_fertility": fertility.query,
    "op6_chosen_path_join": chosen_path.query,
    "op7_shared_prefix_viterbi": pieces.query,
    "op8_licence_paragraphs": licences.query,
    "op9_wavelet_ids": wavelet.query,
    "op10_chat_segments": chat.query,
}
ORACLES: dict[str, str] = {"op6_chosen_path_join": chosen_path.ORACLE, "op10_chat_segments": chat.ORACLE}
