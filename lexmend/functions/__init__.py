"""Column functions."""

from lexmend.functions.codecs import as_binary, as_byte_string, decode, decode_binary, decode_utf8, decode_utf8_variants, encode, replace_lossy_sequences, restore_byte_a0, undo_first_layer, undo_layer
from lexmend.functions.detect import badness, is_ascii, is_bad, is_control_char, may_be_bad, possible_encoding, possible_encodings, utf8_runs
from lexmend.functions.fixers import fix_c1_controls, fix_character_width, fix_latin_ligatures, fix_line_breaks, normalize, remove_control_chars, remove_terminal_escapes, uncurl_quotes, unescape_html
from lexmend.functions.repair import decode_inconsistent_utf8, fix_and_explain, fix_encoding, fix_text, untouched
from lexmend.functions.pieces import lines, segments, sticky_angle

__all__ = [name for name in dir() if not name.startswith("_")]
