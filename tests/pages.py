"""Small pages in the layout the navigation operators read."""


def entry(inner):
    return f"<app-api-doc-item>\n  {inner}\n</app-api-doc-item>"


def header(text):
    return entry(f'<li class="toc-item-divider">\n<a>{text}</a></li>')


def item(text, node_id=None):
    ids = (f' id="{node_id}"', f' id="{node_id}-sp"') if node_id else ("", "")
    return entry(f'<li class="toc-item-highlight clickable"{ids[0]}><div><div><span{ids[1]}> {text}<!----></span></div></div></li>')


def menu(text, nested="", icon="right", node_id=None):
    li_id = f' id="{node_id}"' if node_id else ""
    label = f'<div class="align-middle dds__text-truncate dds__position-relative">{text}</div>'
    return entry(f'<li class="toc-item-highlight clickable"{li_id}><div><i class="dds__icon--chevron-{icon}"></i>{label}</div>{nested}</li>')


def listing(*entries):
    return "<ul>\n" + "\n".join(entries) + "\n</ul>"


def sidebar(*entries):
    return f'<div class="filter-api-sidebar-wrapper">\n{listing(*entries)}\n</div>\n'


LEADING = sidebar(
    header("Authentication"), item("Login", "docs-node-123"), menu("Users"),
    listing(item("Create User", "docs-node-456"), item("Delete User", "docs-node-789")),
)
TRAILING = sidebar(
    item("Get All Items", "docs-node-100"), item("Create Item", "docs-node-200"), menu("Resources"), header("API Resources")
)


def page_table(spark, *pages):
    return spark.createDataFrame(list(enumerate(pages)), "page_id bigint, html string")
