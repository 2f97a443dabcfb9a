-- Input relations of the derived datasets, built from the test tables; one per line.
-- each(a,b,..) repeats a row per listed value; it is written out for the engine that runs it.
-- Remainders of keys choose attribute values and leave some keys without a partner on
-- purpose, so that outer joins, anti joins and NULL rules have something to do.
t_dm_consolidation := select * from (values (653,'N','COMPLETED'),(654,'Y','COMPLETED')) v(consolidation_id,latest,status)
t_dm_in_data_snapshot := select * from (values (1946,'S:UCDP','ALL','N'),(1947,'S:UCDP','ALL','Y'),(2001,'S:NR','ALL','Y'),(2101,'S:RDS','RDS_PRODUCTS','Y'),(2201,'S:PS2','PE_PDP','Y'),(2202,'S:PS2','PE_PLI','Y'),(2301,'S:UCDP','MRN','Y')) v(snapshot_id,supplier_id,data_type,latest)
t_content_collection := select * from (values ('HV','High Value'),('NW','News Wires'),('WN','Web News'),('NR','News Room')) v(content_collection_id,content_collection)
t_all_product_code := select 'NP:P'||cast(p_partkey as string) product_code,'P'||cast(p_partkey as string) mnemonic,p_name name,case p_size%5 when 0 then 'HV' when 1 then 'NW' when 2 then 'WN' when 3 then 'NR' end content_collection_id,case when p_partkey%2=0 then 'S:RCS' else 'S:RDS' end supplier_id,each(653,654) consolidation_id from part
t_all_source_code := select 'NS:S'||cast(c_custkey as string) source_code,'S'||cast(c_custkey as string) mnemonic,c_name name,c_mktsegment descr,'ACTIVE' status,'No Data' availability,case c_nationkey%5 when 0 then 'HV' when 1 then 'NW' when 2 then 'WN' when 3 then 'NR' end content_collection_id,'S:NR' supplier_id,case when c_acctbal<0 then null else 'Pub '||cast(c_nationkey as string) end publisher,case when c_custkey%2=0 then '' else 'http://s.example.com' end url,each(653,654) consolidation_id from customer
t_ref_country := select n_nationkey id,case when n_nationkey=24 then null else n_name end country,each(653,654) consolidation_id from nation
t_ref_region := select r_regionkey id,r_name region,each(653,654) consolidation_id from region
t_ref_publication_type := select v.*,each(653,654) consolidation_id from (values (0,'Wire'),(1,'Web'),(2,'Paper'),(3,'Blog'),(4,'Web')) v(id,publication_type)
t_ref_language := select v.*,each(653,654) consolidation_id from (values (0,'en'),(1,'fr'),(2,'de'),(3,'es')) v(id,language)
t_ref_industry := select v.*,each(653,654) consolidation_id from (values (0,'AUTOMOBILE'),(1,'BUILDING'),(2,'FURNITURE'),(3,'HOUSEHOLD'),(4,'MACHINERY')) v(id,industry)
t_ref_data_relations := select code,code_type,ref_type,case ref_type when 'COUNTRY' then a%25 when 'LANGUAGE' then b%4 else b%5 end ref_id,each(653,654) consolidation_id from (select distinct 'NP:P'||cast(l_partkey as string) code,'NP' code_type,each('COUNTRY','REGION','PUBLICATION','LANGUAGE','INDUSTRY') ref_type,l_partkey+l_suppkey%3 a,l_partkey+l_orderkey%2 b from lineitem where l_partkey%3<>0 union select 'NS:S'||cast(o_custkey as string),'NS',each('COUNTRY','REGION','PUBLICATION','LANGUAGE','INDUSTRY') ref_type,o_custkey+o_orderkey%3,o_custkey+o_orderkey%2 from orders where o_custkey%4<>0) r
ucdp_v_feed := select 'news_'||cast(user_id as string) feed_code,event_id feed_index,cast(event_id%2 as string) isnative,'1' isinternal,cast(user_id as string) feedid,'visible' visibility,event_type state,case event_type when 'error' then null when 'view' then '' else 'Owner' end copyrightOwner,event_type description,'parsn_'||event_type parser,case event_type when 'error' then null else 'Parser '||event_type end parser_descr,case event_type when 'click' then null else 'onbdn_'||event_type end onboarder,case event_type when 'click' then null else 'Onboarder '||event_type end onboarder_descr,case when event_id%10=0 then 1946 else 1947 end snapshot_id from events
ucdp_feed_to_sc := select distinct 'news_'||cast(user_id as string) feed_code,'S'||cast(event_id%(select 2*max(c_custkey) from customer) as string) source_code,case when event_id%10=0 then 1946 else 1947 end snapshot_id from events where user_id%10<>9
t_feeds := select f.*,each(653,654) consolidation_id from (select feed_code,max(description) description,max(parser) parser,max(parser_descr) parser_descr,max(onboarder) onboarder,max(onboarder_descr) onboarder_descr,max(copyrightOwner) copyrightOwner,count(*) feed_instance_count from ucdp_v_feed where snapshot_id=1947 group by feed_code) f
t_mapped_source_code := select source_code,mnemonic,name,content_collection_id,consolidation_id from t_all_source_code
t_feed_source_code := select distinct u.feed_code,s.source_code,s.content_collection_id sc_content_collection_id,s.consolidation_id from ucdp_feed_to_sc u join t_all_source_code s on s.mnemonic=u.source_code where u.snapshot_id=1947
t_product_code_source_code := select distinct 'NP:P'||cast(l_partkey as string) product_code,'NS:S'||cast(o_custkey as string) source_code,each(653,654) consolidation_id from lineitem join orders on l_orderkey=o_orderkey
t_feed_product_code := select distinct f.feed_code,p.product_code,f.consolidation_id from t_feed_source_code f join t_product_code_source_code p on p.source_code=f.source_code and p.consolidation_id=f.consolidation_id
t_feed_pe_code := select 'news_'||cast(user_id as string) feed_code,cast(event_id%97 as string) pe_code,each(653,654) consolidation_id from events
t_feed_codes := select feed_code,source_code code,consolidation_id from t_feed_source_code union select feed_code,product_code,consolidation_id from t_feed_product_code
nsa_v_code_country := select r.code,v.country,r.consolidation_id from t_ref_data_relations r join t_ref_country v on v.id=r.ref_id and v.consolidation_id=r.consolidation_id where r.ref_type='COUNTRY'
nsa_v_code_region := select r.code,v.region,r.consolidation_id from t_ref_data_relations r join t_ref_region v on v.id=r.ref_id and v.consolidation_id=r.consolidation_id where r.ref_type='REGION'
nsa_v_code_industry := select r.code,v.industry,r.consolidation_id from t_ref_data_relations r join t_ref_industry v on v.id=r.ref_id and v.consolidation_id=r.consolidation_id where r.ref_type='INDUSTRY'
nsa_v_pc_country := select distinct code product_code,ref_id country_id,consolidation_id from t_ref_data_relations where code_type='NP' and ref_type='COUNTRY'
nsa_v_pc_region := select distinct code product_code,ref_id region_id,consolidation_id from t_ref_data_relations where code_type='NP' and ref_type='REGION'
nsa_v_pc_industry := select distinct code product_code,ref_id industry_id,consolidation_id from t_ref_data_relations where code_type='NP' and ref_type='INDUSTRY'
nsa_v_sc_country := select distinct code source_code,ref_id country_id,consolidation_id from t_ref_data_relations where code_type='NS' and ref_type='COUNTRY'
nsa_v_sc_region := select distinct code source_code,ref_id region_id,consolidation_id from t_ref_data_relations where code_type='NS' and ref_type='REGION'
nsa_v_sc_industry := select distinct code source_code,ref_id industry_id,consolidation_id from t_ref_data_relations where code_type='NS' and ref_type='INDUSTRY'
t_all_pc_ref_grouped := select p.product_code,p.name,p.content_collection_id,cc.content_collection,min(k.country) country,min(r.region) region,min(i.industry) industry,p.consolidation_id from t_all_product_code p left join t_content_collection cc on cc.content_collection_id=p.content_collection_id left join (select code,consolidation_id,min(country) country from nsa_v_code_country group by code,consolidation_id) k on k.code=p.product_code and k.consolidation_id=p.consolidation_id left join (select code,consolidation_id,min(region) region from nsa_v_code_region group by code,consolidation_id) r on r.code=p.product_code and r.consolidation_id=p.consolidation_id left join (select code,consolidation_id,min(industry) industry from nsa_v_code_industry group by code,consolidation_id) i on i.code=p.product_code and i.consolidation_id=p.consolidation_id group by p.product_code,p.name,p.content_collection_id,cc.content_collection,p.consolidation_id
t_all_sc_ref_grouped := select p.source_code,p.name,p.content_collection_id,cc.content_collection,min(k.country) country,min(r.region) region,min(i.industry) industry,p.consolidation_id from t_all_source_code p left join t_content_collection cc on cc.content_collection_id=p.content_collection_id left join (select code,consolidation_id,min(country) country from nsa_v_code_country group by code,consolidation_id) k on k.code=p.source_code and k.consolidation_id=p.consolidation_id left join (select code,consolidation_id,min(region) region from nsa_v_code_region group by code,consolidation_id) r on r.code=p.source_code and r.consolidation_id=p.consolidation_id left join (select code,consolidation_id,min(industry) industry from nsa_v_code_industry group by code,consolidation_id) i on i.code=p.source_code and i.consolidation_id=p.consolidation_id where p.consolidation_id=654 group by p.source_code,p.name,p.content_collection_id,cc.content_collection,p.consolidation_id
t_all_sc_journalCode := select 'S'||cast(o_custkey as string) source_code,'Prov '||cast(o_orderkey%7 as string) provider from orders
bpsa_reference_data := select 'NS:S'||cast(o_custkey as string) source_code,cast(o_orderkey%4 as string) code,case when o_orderkey%11=0 then null else 'Name '||cast(o_orderkey%9 as string) end value,'NAME' category,'TRANSLATEDNAME' data_type,case when o_orderkey%6=0 then 2000 else 2001 end snapshot_id from orders union all select 'NS:S'||cast(c_custkey as string),'x',case c_custkey%5 when 0 then cast(c_custkey as string) when 1 then cast(c_custkey as string)||'M' when 2 then 'M' when 3 then '12-34' end,'ENTITLEMENT','PECODE',2001 from customer
bpsa_source_code := select case when c_custkey%2=0 then 'NS:S' else 'S' end||cast(c_custkey as string) source_code,c_name name,c_mktsegment descr,'ACTIVE' status,'Full' availability,case c_custkey%4 when 0 then 'WEBNEWS' when 1 then 'NEWSROOM' when 2 then 'REFINITIV' else 'OTHER' end contentSet,'Pub' publisher,cast(null as string) url,case when c_custkey%9=0 then 2000 else 2001 end snapshot_id from customer where c_custkey%3<>0
bpsa_v_product_code_source_code := select 'S'||cast(o_custkey as string) source_code,'P'||cast(l_partkey as string) product_code from lineitem join orders on l_orderkey=o_orderkey union all select case when c_custkey%2=0 then 'NS:S' else 'S' end||cast(c_custkey as string),'RFTHVS' from customer where c_custkey%7=0
rcs_v_source_code := select case when c_custkey%10=0 then 'NS:S' else 'S' end||cast(c_custkey as string) source_code,c_name name,c_mktsegment definition from customer where c_custkey%5=0
rds_v_source_code := select 'NS:S'||cast(c_custkey as string) source_code,c_name source_name from customer where c_custkey%2=0
rcs_v_product_code := select case when p_partkey%4=0 then 'NP:P' else 'P' end||cast(p_partkey as string) product_code,p_name name,p_type definition from part where p_partkey%2=0
rds_v_product_code := select 'NP:P'||cast(p_partkey as string) product_code,p_name product_name from part where p_partkey%3=0 union all select 'No Product Code','none'
rcs_v_product_code_source_code := select 'NP:P'||cast(l_partkey as string) product_code,case when l_orderkey%2=0 then 'NS:S' else 'S' end||cast(o_custkey as string) source_code from lineitem join orders on l_orderkey=o_orderkey
rds_product_code := select 'NP:P'||cast(p_partkey as string) product_code,p_name product_name,'S'||cast(p_size as string) source_codes,case when p_partkey%6=0 then 1 else 0 end not_product_code,case when p_partkey%10=0 then 1 else 0 end exclude_from_eikon,case when p_partkey%8=0 then 2100 else 2101 end snapshot_id from part
rds_reference_data := select 'NP:P'||cast(p_partkey as string) code,'NP' code_type,'RUN_PE' data_type,case p_partkey%6 when 0 then 'N/A' when 1 then cast(p_partkey%200 as string)||'M' when 2 then null when 3 then 'M' else cast(p_partkey%200 as string) end value,2101 snapshot_id from part union all select 'NP:P'||cast(p_partkey as string),'NP','LANGUAGE',each('en','fr',null),2101 from part where p_partkey%3=0 union all select 'NP:P'||cast(p_partkey as string),'NP','IS_NOT_PROD_CODE',case when p_partkey%2=0 then 'N' else 'Y' end,2101 from part union all select 'NS:S'||cast(c_custkey as string),'NS','EXCLUDE_FROM_EIKON',case when c_custkey%3=0 then 'true' else 'false' end,case when c_custkey%9=0 then 2100 else 2101 end from customer
rds_v_reference_data := select code,code_type,data_type,value from rds_reference_data where snapshot_id=2101
t_ps2_pdp_pe := select cast(s_suppkey as string) pe_code,case s_suppkey%4 when 0 then 'WWEIKON' when 1 then 'WWRFTW' else 'PDP' end||cast(s_suppkey%20 as string) pdp_code,2201 snapshot_id from supplier
t_ps2_pdp := select distinct pdp_code,case when pe_code like '%1%' then 'Specialist' else 'General' end pdp_type,case when pe_code like '%2%' then 'LUCY CHAPLE' else 'OTHER' end owner,snapshot_id from t_ps2_pdp_pe
t_ps2_pli := select case when s_suppkey%3=0 then 'XXX' else 'RRG' end product_status,'K1 '||p.pdp_code||' K2' permissioning_key,2202 snapshot_id from supplier join t_ps2_pdp_pe p on p.pe_code=cast(s_suppkey as string)
t_ps2_pe := select cast(s_suppkey as string) pe_code,s_name pe_name,case when s_suppkey%9=0 then 2200 else 2201 end snapshot_id from supplier
t_mrn_pe_rules := select cast(s_suppkey as string) pe_code,case when s_suppkey%5=0 then 2300 else 2301 end snapshot_id from supplier
t_mrn_rule_details := select cast(s_suppkey as string) pe_code,left(v,length(v)-1) type,v value,2301 snapshot_id from (select s_suppkey,each('PROVIDER1','PROVIDER2','LANGUAGE1','LANGUAGE2','URGENCY1','AUDIENCE1','SUBJECT1','INSTANCE1','FULL_LANGUAGE1') v from supplier) x where (s_suppkey+cast(right(v,1) as int))%3<>0
nsa_v_mrn_pe_pc := select distinct 'NP:P'||cast(l_partkey as string) product_code,l_suppkey pe_code from lineitem
nsa_v_mrn_pe_sc := select distinct 'NS:S'||cast(o_custkey as string) source_code,o_orderkey%50 pe_code from orders
