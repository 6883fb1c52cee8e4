from platewise.functions.expressions import (  # noqa: F401
    main_cuisine,
    to_number,
    word_tokens,
    yes_no_flag,
    round6,
)
