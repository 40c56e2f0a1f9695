from .scalar import contains_literal, default_to, escape_quotes, js_string, leading_int, loose_equal, regex_find, truthy

__all__ = ["contains_literal", "default_to", "escape_quotes", "js_string", "leading_int", "loose_equal", "regex_find", "truthy"]
